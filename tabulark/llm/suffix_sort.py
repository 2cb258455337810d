"""Deep-shallow sorting of byte strings: multikey quicksort, then blind tries.

Strings are first ordered by multikey quicksort on their first SHALLOW bytes after a
known common prefix.  Groups still equal there have long common prefixes; each is
ordered by a blind trie, which keeps branching characters and skips only, finds a leaf
by them without comparing, and then compares once with that leaf.
"""

from __future__ import annotations

from bisect import bisect_left

SHALLOW = 32
#: Groups up to this size are ordered by plain comparison.
FEW = 3


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first `start` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Inserts strings one by one; leaves come out in order with their common prefixes.

    A node is [skip, keys, children]: keys are sorted next characters (-1: the string's
    end) at depth skip.  A leaf is a list of the numbers of equal strings.
    """

    __slots__ = ("strings", "known", "root")

    def __init__(self, strings: list[bytes], known: int):
        self.strings, self.known, self.root = strings, known, None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = (i,)
            return
        path, node = [], self.root
        while isinstance(node, list):  # blind: only branching characters are looked at
            c = self._at(s, node[0])
            k = bisect_left(node[1], c)
            if k == len(node[1]) or node[1][k] != c:
                k = min(k, len(node[1]) - 1)
            path.append((node, k))
            node = node[2][k]
        other = self.strings[node[0]]
        depth = common_prefix(s, other, self.known)
        if depth == len(s) == len(other):
            self._replace(path, node + (i,))
            return
        # The place is above the first node that skips past the mismatch.
        above = len(path)
        while above and path[above - 1][0][0] > depth:
            above -= 1
        c = self._at(s, depth)
        if above and path[above - 1][0][0] == depth:
            at = path[above - 1][0]
            k = bisect_left(at[1], c)
            at[1].insert(k, c)
            at[2].insert(k, (i,))
            return
        below = path[above][0] if above < len(path) else node
        d = self._at(other, depth)
        new = [depth, [c, d], [(i,), below]] if c < d else [depth, [d, c], [below, (i,)]]
        self._replace(path[:above], new)

    def _replace(self, path: list, node) -> None:
        if path:
            path[-1][0][2][path[-1][1]] = node
        else:
            self.root = node

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and each one's common prefix with the one before (the first: 0)."""
        order: list[int] = []
        lcp: list[int] = []
        todo = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, tuple):
                for n, i in enumerate(node):
                    order.append(i)
                    lcp.append(len(self.strings[i]) if n else depth)
                continue
            for k in range(len(node[2]) - 1, -1, -1):
                todo.append((node[2][k], node[0] if k else depth))
        if lcp:
            lcp[0] = 0
        return order, lcp


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings (which share `known` first bytes) and common prefixes of neighbours in it."""
    order: list[int] = []
    todo = [(list(range(len(strings))), known)]
    deep = known + shallow
    while todo:
        group, depth = todo.pop()
        if len(group) <= FEW:
            order += sorted(group, key=lambda i: strings[i])
        elif depth >= deep:
            trie = BlindTrie(strings, depth)
            for i in group:
                trie.add(i)
            order += trie.ordered()[0]
        else:  # three ways by the character at this depth, with the middle one's as pivot
            at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
            pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
            low = [i for i, c in zip(group, at) if c < pivot]
            same = [i for i, c in zip(group, at) if c == pivot]
            high = [i for i, c in zip(group, at) if c > pivot]
            if high:
                todo.append((high, depth))
            if pivot < 0:
                # These end here, so they are equal; they come after the lower ones, of which there are none.
                order += same
            else:
                todo.append((same, depth + 1))
            if low:
                todo.append((low, depth))
    lcp = [0] * len(order)
    for k in range(1, len(order)):
        lcp[k] = common_prefix(strings[order[k - 1]], strings[order[k]], known)
    return order, lcp

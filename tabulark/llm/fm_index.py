"""FM-index over a sequence of integers: wavelet-matrix ranks and sampled suffix positions, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; `text` must end in a unique smallest symbol.

    After the first sort only suffixes of still equal rank are sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    first = np.concatenate(([True], sorted_text[1:] != sorted_text[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    h = 1
    while True:
        alone = first & np.concatenate((first[1:], [True]))
        at = np.flatnonzero(~alone)
        if not len(at):
            return order
        suffixes = order[at]
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + h, n - 1)]
        inner = np.argsort(key, kind="stable")
        order[at], key = suffixes[inner], key[inner]
        # Ranks of groups stay in their places, as `at` lists whole groups in order.
        first[at] = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = head
        h *= 2


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols, for arrays of c and i at once."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.ones, self.zeros = [], []
        current = symbols
        for level in reversed(range(self.levels)):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(current) - int(self.ones[-1][-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            before = ones[i]
            i = np.where((c >> level) & 1, zeros + before, i - before)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self._down(c, np.zeros_like(i))

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            before = ones[i]
            bit = ones[i + 1] - before
            c |= bit.astype(i.dtype) << level
            i = np.where(bit, zeros + before, i - before)
        return c


class FMIndex:
    """Counts and locates patterns in `text` (symbols from 1; 0 is the end mark added here)."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 16):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))[:-1]
        self.bwt = WaveletMatrix(text[order - 1], alphabet)
        sampled = (order % sample) == 0
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.places = order[sampled]

    def intervals(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of `patterns` (right-aligned) at once: row ranges of their suffixes."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            alive = alive[(lengths[alive] > step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            c = patterns[alive, patterns.shape[1] - 1 - step]
            low[alive] = self.before[c] + self.bwt.rank(c, low[alive])
            high[alive] = self.before[c] + self.bwt.rank(c, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walked back to the nearest sampled position."""
        out = np.empty(len(rows), np.int64)
        at, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(at):
            hit = self.sampled[row + 1] > self.sampled[row]
            out[at[hit]] = self.places[self.sampled[row[hit]]] + steps
            at, row = at[~hit], row[~hit]
            c = self.bwt.access(row)
            row = self.before[c] + self.bwt.rank(c, row)
            steps += 1
        return out

"""Ids of a lower-casing word BPE tokenizer for whole batches, the same as the tokenizer's own.

Splitting is vectorised over code points; each distinct word is encoded once by the
tokenizer and remembered.  Texts with a character outside a checked range, text not in
composed form, or special-token strings go through the tokenizer as they are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash
from tokenizers import Tokenizer

from . import bytes_kernel as bk

#: Code points whose classes are asked of the tokenizer; others take the plain way.
RANGES = ((0x0000, 0x0530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2190, 0x2300))
REMEMBERED = 2_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Apostrophe endings that are words of their own, as the tokenizer's pattern has them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_CODES = np.random.default_rng(5).integers(1, 2**63, RANGES[-1][1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _classes(tokenizer: Tokenizer) -> np.ndarray:
    """The class of each code point in RANGES by how the tokenizer splits around it; -1 elsewhere."""
    split = lambda s: len(tokenizer.pre_tokenizer.pre_tokenize_str(s))
    out = np.full(RANGES[-1][1], -1, np.int8)
    for low, high in RANGES:
        for c in range(low, high):
            x = chr(c)
            if split(x) == 0:
                out[c] = SPACE
            elif split(f"a{x}a") == 1:
                out[c] = LETTER
            elif split(f"{x}{x}") == 2:
                out[c] = NUMBER
            elif split(f"!{x}!") == 1:
                out[c] = OTHER
            if tokenizer.normalizer.normalize_str(f"a{x}b") != f"a{x}b" and out[c] != SPACE:
                out[c] = -1  # it changes in lower-cased text
    return out


class WordBpe:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        vocabulary, specials = spec["model"]["vocab"], [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.classes = _classes(self.whole)
        spec |= {"normalizer": None, "added_tokens": [], "post_processor": None}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.pool, self.first, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _remember(self, hashes: list[int], words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.words.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a word was split by the tokenizer")
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            while len(self.slot) + len(part) + 1 > len(self.first):
                self.first = np.concatenate((self.first, np.zeros_like(self.first)))
            self.pool[self.used : self.used + len(ids)] = ids
            n = len(self.slot)
            self.first[n + 1 : n + 1 + len(part)] = self.used + ends
            self.slot.update(zip(hashes[at : at + 4096], range(n, n + len(part))))
            self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids joined, and the offsets of each text."""
        folded, odd = [], {}
        for i, text in enumerate(texts):
            text = text or ""
            if "<|" in text and self.special and self.special.search(text) or not unicodedata.is_normalized("NFC", text) or "Σ" in text:
                odd[i] = text
                text = ""
            folded.append(text.lower())
        joined = "\n".join(folded) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = points < len(self.classes)
        kind = np.where(inside, self.classes[np.minimum(points, len(self.classes) - 1)], -1)
        lengths = np.array([len(t) + 1 for t in folded], np.int64)
        ends = np.cumsum(lengths)
        strange = np.flatnonzero(kind < 0)
        if len(strange):
            for i in np.unique(np.searchsorted(ends, strange, "right")).tolist():
                odd[i] = texts[i] or ""
                kind[ends[i] - lengths[i] : ends[i]] = SPACE
        start, stop = self._split(points, kind)
        sums = np.empty(len(points) + 1, np.uint64)
        sums[0] = 0
        up, down = bk.powers(len(points))
        np.cumsum(_CODES[np.minimum(points, len(_CODES) - 1)] * up[:-1], out=sums[1:])
        words = bk.mix((sums[stop] - sums[start]) * down[start])
        for i in np.flatnonzero(stop - start > bk.SHORT).tolist():
            words[i] = xxhash.xxh3_64_intdigest(joined[start[i] : stop[i]].encode("utf-8", "surrogatepass"))
        distinct, where, of = np.unique(words, return_index=True, return_inverse=True)
        if len(self.slot) > REMEMBERED:
            self.forget()
        keys = distinct.tolist()
        known = self.slot
        new = [k for k in range(len(keys)) if keys[k] not in known]
        if new:
            spans = where[new]
            self._remember([keys[k] for k in new], [joined[a:b] for a, b in zip(start[spans].tolist(), stop[spans].tolist())])
        slots = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[of]
        n_ids = self.first[slots + 1] - self.first[slots]
        ids = self.pool[bk.ragged(self.first[slots], n_ids)]
        counts = np.bincount(np.searchsorted(ends, start, "right"), n_ids, len(texts)).astype(np.int64)
        if odd:
            return self._with(odd, ids, counts)
        return ids, np.concatenate(([0], np.cumsum(counts)))

    def _with(self, odd: dict[int, str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, text in odd.items():
            parts[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    @staticmethod
    def _split(points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters and of others, single numbers, and apostrophe endings."""
        n = len(points)
        change = np.ones(n, bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start = np.flatnonzero(change)
        stop = np.append(start[1:], n)
        lone = np.flatnonzero((kind[start[:-1]] == OTHER) & (stop[:-1] - start[:-1] == 1) & (points[start[:-1]] == 0x27) & (kind[start[1:]] == LETTER))
        if len(lone):
            at, room = start[lone + 1], (stop - start)[lone + 1]
            a, b = points[at], points[np.minimum(at + 1, n - 1)]
            taken = np.zeros(len(lone), np.int64)
            for ending in ENDINGS:
                fits = (a == ord(ending[0])) & (room >= len(ending))
                if len(ending) == 2:
                    fits &= b == ord(ending[1])
                taken[fits & (taken == 0)] = len(ending)
            stop[lone] += taken
            start[lone + 1] += taken
        full = (kind[start.clip(max=n - 1)] != SPACE) & (stop > start)
        return start[full], stop[full]


@lru_cache(maxsize=2)
def shared(path: str) -> WordBpe:
    """One tokenizer and memory for each Python worker."""
    return WordBpe(path)

"""Counts of quality rules for whole texts, vectorised over batches of documents."""

from __future__ import annotations

import numpy as np

from . import bytes_kernel as bk

REPEAT_WINDOW = 8

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_echoes")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return h ^ bk.mix(doc.astype(np.uint64) + np.uint64(0x51ED270B))


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each document has."""
    key = _salted(h, doc)
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    return np.bincount(doc[order[first]], minlength=n)


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each document, as int64 arrays.

    Words are `[^\\x20\\x09-\\x0D]+`; repeat words are those in windows of eight words
    found twice or more in the text, the first included; duplicate lines have a word and
    equal an earlier line.
    """
    n = len(offsets) - 1
    starts, ends, doc = bk.runs(data, offsets, bk.SPACED_WORD)
    sums = bk.Prefix(data)
    words = sums.hash(starts, ends)
    out = {"n_words": np.bincount(doc, minlength=n)}
    lead = _LEAD[data]
    out["word_chars"] = _sums(lead & bk.SPACED_WORD[data], offsets)
    out["n_symbols"] = _sums(_SYMBOL[data], offsets)
    out["n_upper"] = _sums(_UPPER[data], offsets)
    out["n_digits"] = _sums(_DIGIT[data], offsets)
    out["n_marks"] = _sums(_MARK[data], offsets)

    lo, hi, line_doc = bk.runs(data, offsets, bk.NOT_NEWLINE)
    spoken = np.concatenate(([0], np.cumsum(bk.SPACED_WORD[data] & (data != 10), dtype=np.int64)))
    full = spoken[hi] > spoken[lo]
    lo, hi, line_doc = lo[full], hi[full], line_doc[full]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(sums.hash(lo, hi), line_doc, n)

    windows, at = bk.window_hash(words, doc, REPEAT_WINDOW)
    key = _salted(windows, doc[at])
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(ordered) else np.zeros(0, bool)
    cover = np.zeros(len(words) + 1, np.int64)
    found = at[order[twice]]
    np.add.at(cover, found, 1)
    np.add.at(cover, found + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    echo = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out["n_echoes"] = np.bincount(doc[1:][echo], minlength=n)
    out["n_distinct_words"] = _distinct(words, doc, n)
    return {k: out[k].astype(np.int64) for k in COUNTS}

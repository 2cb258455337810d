"""Vectorised views of a batch of texts as UTF-8 bytes: words, lines, window hashes.

All functions work on one contiguous byte array and the offsets of its documents, so
no Python object is made for a word.  Ranges of up to SHORT bytes are hashed as polynomials modulo
2**64 over a fixed random byte table, mixed at the end; such sums collide for some regular texts of
many hundred bytes, so longer ranges are hashed one by one by XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD = _FOLD.astype(np.uint8)
#: Ranges up to this length are hashed by differences of prefix sums.
SHORT = 64
STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)

#: Bytes of words in `[^\x20\x09-\x0D]+`.
SPACED_WORD = np.ones(256, bool)
SPACED_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, A-Z counted as a-z.
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _cached_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(BASE, n), _powers(BASE_INVERSE, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n."""
    if n <= CHUNK_BYTES + 1:
        up, down = _cached_powers(CHUNK_BYTES + 1)
        return up[: n + 1], down[: n + 1]
    return _powers(BASE, n + 1), _powers(BASE_INVERSE, n + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges with about `most` bytes of text, at least one row each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, offsets = utf8(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Prefix:
    """Hashes of any byte ranges of data by their content alone; fold: A-Z count as a-z."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        self.data = np.ascontiguousarray(_FOLD[data] if fold else data)
        self.up, self.down = powers(len(data))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(BYTE_CODE[self.data] * self.up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.sums[end] - self.sums[start]) * self.down[start])
        long = np.flatnonzero(end - start > SHORT)
        if len(long):
            body, digest = memoryview(self.data), xxhash.xxh3_64_intdigest
            out[long] = [digest(body[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
        return out


def sequence_hash(values: np.ndarray, first: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A hash of each sequence values[first[i]:first[i + 1]], of its values and their places."""
    counts = np.diff(first)
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(first[:-1], counts).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ mix(place * STEPS[63] + salt)))))
    return mix(sums[first[1:]] - sums[first[:-1]] + counts.astype(np.uint64) * STEPS[62])


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes, cut at documents: starts, ends, document index."""
    inside = member[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, joined."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def window_hash(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` consecutive words inside one document, and their first word's index."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n] * STEPS[0]
    for i in range(1, size):
        h += words[i : n + i] * STEPS[i]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(h[at]), at


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)

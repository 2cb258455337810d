"""Fill-in-the-middle: texts cut at unit boundaries and written prefix, suffix, middle.

A unit is a run of A-Z and a-z, or any other code point.  A table-driven automaton over UTF-8 bytes has four states
(after another code point, in a letter run, after `<`, after `<` and one of P, S, M) and a counted transition for each of state and byte: units begun,
code points begun, sentinels ended.  The first pass steps through all blocks of BLOCK bytes side by side, from every state
that a block may begin in, so each byte is read once; a walk over the blocks then picks the states they do begin in.  The second pass
steps through the blocks that hold a cut only, up to the cut.

Defined cases: a null text is an empty one; an empty text, one with a sentinel in it, and those that the hash leaves plain come out as they are; a null id is
hashed like an empty one; rows alike come out alike; other columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_kernel as bk
from .arrow_rows import quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 512
CHUNK_BYTES = 4 << 20
#: Of 100 documents, so many are cut; of these, so many of 100 have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20

STATES = OTHER, LETTERS, OPENED, NAMED = range(4)
#: Counted transitions are packed in an integer: units, code points and sentinels have WIDTH bits each.
WIDTH = 20
UNIT, POINT, SENTINEL = 1, 1 << WIDTH, 1 << 2 * WIDTH
_LOW = (1 << WIDTH) - 1


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, counted transition) at state * 256 + byte."""
    to, counts = np.zeros(1024, np.uint16), np.zeros(1024, np.int64)
    for state in STATES:
        for byte in range(256):
            at, c = state << 8 | byte, chr(byte)
            if 0x80 <= byte < 0xC0:  # a continuation belongs to the code point before it
                to[at] = state
            elif byte < 0x80 and c.isalpha():
                to[at] = NAMED if state == OPENED and c in "PSM" else LETTERS
                counts[at] = POINT + (UNIT if state in (OTHER, OPENED) else 0)
            else:
                to[at] = OPENED if c == "<" else OTHER
                counts[at] = POINT + UNIT + (SENTINEL if c == ">" and state == NAMED else 0)
    return to, counts


def _blocks(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the blocks of each document, and the first block of each."""
    lengths = np.diff(offsets)
    per_doc = -(-lengths // size)
    first = np.concatenate(([0], np.cumsum(per_doc)))
    place = bk.ragged(np.zeros(len(per_doc), np.int64), per_doc) * size
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    return offsets[:-1][doc] + place, np.minimum(size, lengths[doc] - place), first


def _counted(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block and each state it may begin in: the state it ends in and its counted transitions."""
    to, counts = automaton()
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = np.tile(np.arange(4, dtype=np.uint16), (len(starts), 1))
    total = np.zeros((len(starts), 4), np.int64)
    live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    for i, k in enumerate(live.tolist()):  # the k longest blocks have a byte i
        at = (state[:k] << 8) | data[starts[:k] + i][:, None]
        total[:k] += counts[at]
        state[:k] = to[at]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return state[back], total[back]


def _located(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where unit nth (from 0) of each block begins, and the code points of the block before it; blocks begin in the given states."""
    to, counts = automaton()
    state, total = state.astype(np.uint16), np.zeros(len(starts), np.int64)
    place, points = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for i in range(int(lengths.max()) if len(lengths) else 0):
        at = (state[todo] << 8) | data[starts[todo] + i]
        before = total[todo]
        total[todo] = after = before + counts[at]
        state[todo] = to[at]
        found = (after & _LOW) > nth[todo]
        here = todo[found]
        place[here], points[here] = starts[here] + i, before[found] >> WIDTH & _LOW
        todo = todo[~found]
        if not len(todo):
            break
    return place, points


class Scanned:
    """What the first pass finds of some documents: n_units, n_points, has_sentinel; `cut` makes the second pass."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.data, self.offsets = data, offsets
        self.starts, self.lengths, self.first = _blocks(offsets, block)
        ends, counts = _counted(data, self.starts, self.lengths)
        ends, heads = ends.tolist(), np.zeros(len(self.starts), np.int64)
        begins = set(self.first[:-1].tolist())
        state = OTHER
        for b in range(len(ends)):
            state = OTHER if b in begins else state
            heads[b] = state
            state = ends[b][state]
        self.heads = heads
        own = counts[np.arange(len(heads)), heads] if len(heads) else np.zeros(0, np.int64)
        self.units, self.points, sentinels = (np.concatenate(([0], np.cumsum(own >> s & _LOW))) for s in (0, WIDTH, 2 * WIDTH))
        per_doc = lambda sums: sums[self.first[1:]] - sums[self.first[:-1]]
        self.n_units, self.n_points, self.has_sentinel = per_doc(self.units), per_doc(self.points), per_doc(sentinels) > 0

    def cut(self, docs: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code point at which each of `docs` has had so many units; all units: its end."""
        place, points = self.offsets[docs + 1].copy(), self.n_points[docs].copy()
        inner = np.flatnonzero(units < self.n_units[docs])
        d, u = docs[inner], units[inner]
        nth = self.units[self.first[d]] + u
        block = np.searchsorted(self.units, nth, "right") - 1
        place[inner], within = _located(self.data, self.starts[block], self.lengths[block], self.heads[block], nth - self.units[block])
        points[inner] = self.points[block] - self.points[self.first[d]] + within
        return place, points


def hash_numbers(key: Column, seed: str = "1") -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `seed:id`, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] | None = None, seed: str = "1") -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output): whole texts, cut as the hash of their id says."""
    columns = docs.columns if carry is None else list(carry)
    keyed = docs.select(
        F.struct(*[F.col(quoted(c)) for c in columns]).alias("doc"), F.col(quoted(text)).cast("string").alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(hash_numbers(F.col(quoted(key)), seed), 1)],
    )
    schema = T.StructType([keyed.schema["doc"], *T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in bk.chunks(batches, "text", CHUNK_BYTES):
            h = [batch.column(i).to_numpy() for i in range(2, 6)]
            scan = Scanned(data, offsets)
            n = scan.n_units
            plain = (n == 0) | scan.has_sentinel | (h[2] % 100 >= CUT_PERCENT)
            suffix_first = h[3] % 100 < SUFFIX_FIRST_PERCENT
            x, y, every = h[0] % (n + 1), h[1] % (n + 1), np.arange(len(n))
            (a, a_points), (b, b_points) = scan.cut(every, np.minimum(x, y)), scan.cut(every, np.maximum(x, y))
            raw, out = memoryview(np.ascontiguousarray(data)), []
            for lo, p, q, hi, is_plain, is_spm in zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), plain.tolist(), suffix_first.tolist()):
                if is_plain:
                    out.append(bytes(raw[lo:hi]))
                elif is_spm:
                    out.append(b"".join((b"<S>", raw[q:hi], b"<P>", raw[lo:p], b"<M>", raw[p:q])))
                else:
                    out.append(b"".join((b"<P>", raw[lo:p], b"<S>", raw[q:hi], b"<M>", raw[p:q])))
            form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
            columns = [pa.array(n), pa.array(form), pa.array(a_points, mask=plain), pa.array(b_points - a_points, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return keyed.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; only plain outputs have sentinels of their own."""
    part = F.split(output, "<[PSM]>")
    prefix, suffix = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))

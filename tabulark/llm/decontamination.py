"""Benchmark decontamination: an FM-index per shard of documents, searched for benchmark windows.

Texts are lower-cased (A-Z) and cut into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.  Words
that no benchmark item has can't be in an occurrence, so a shard's index holds only its
runs of benchmark words, as word numbers with a mark between runs.  All windows (13
words, or a whole shorter item) are searched backward at once through wavelet ranks,
their occurrences located by sampled suffix positions, and overlapping spans merged.

The benchmark is sent to the executors in blocks of about BLOCK_WINDOWS windows, one pass and one block at a time.  One
block needs no shuffle; with more, each pass writes the few documents it hits and their spans are merged by row.

Defined cases: a null or wordless text has no words and no hits; items without words
are skipped; a null item id counts as an empty one; equal ids count once; repeated rows are judged each; other
columns are carried in `doc` under whatever names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_kernel as bk
from .arrow_rows import carried, quoted
from .fm_index import FMIndex
from .scratch import Scratch

WINDOW = 13
BLOCK_WINDOWS = 200_000
SHARD_BYTES = 16 << 20
_SPANS = "array<struct<lo:long,hi:long,first:long,after:long>>"  # byte and word ranges
_FIRST = 2  # symbols: 0 end mark, 1 between runs, then words


class Windows:
    """The distinct windows of some items: a vocabulary, patterns and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, offsets = bk.utf8(pa.array([t for _, t in items], pa.string()))
        starts, ends, doc = bk.runs(data, offsets, bk.PLAIN_WORD)
        words = bk.Prefix(data, fold=True).hash(starts, ends)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        number = number.astype(np.int64) + _FIRST
        lengths = np.bincount(doc, minlength=len(items))
        first = np.concatenate(([0], np.cumsum(lengths)))
        found: dict[tuple, list[str]] = {}
        for i, (name, _) in enumerate(items):
            own = number[first[i] : first[i + 1]].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[at : at + window]), []).append(name)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, p in enumerate(found):
            self.patterns[row, window - len(p) :] = p
        owners = [sorted(set(x)) for x in found.values()]
        self.names = sorted({x for own in owners for x in own})
        where = {x: i for i, x in enumerate(self.names)}
        self.owner_first = np.concatenate(([0], np.cumsum([len(own) for own in owners]))).astype(np.int64)
        self.owners = np.array([where[x] for own in owners for x in own], np.int64)
        self.shortest = int(self.lengths.min()) if len(found) else 0
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Word hashes as symbols; 0 for words of no item."""
        out = np.zeros(len(words), np.int64)
        at = np.flatnonzero(self.maybe[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == words[at]
        out[at[known]] = place[known] + _FIRST
        return out


class Shard:
    """Collects documents; `search` finds all windows in them."""

    def __init__(self, windows: Windows):
        self.windows, self.docs, self.bytes = windows, 0, 0
        self.n_words: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        w = self.windows
        starts, ends, doc = bk.runs(data, offsets, bk.PLAIN_WORD)
        words = bk.Prefix(data, fold=True).hash(starts, ends)
        n = len(offsets) - 1
        self.n_words.append(np.bincount(doc, minlength=n))
        if len(w.vocabulary) and len(words):
            number = w.numbers(words)
            inside = number > 0
            same = doc[1:] == doc[:-1]
            begin = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1] & same)))
            end = np.flatnonzero(inside & ~np.concatenate((inside[1:] & same, [False]))) + 1
            long = end - begin >= w.shortest
            at = bk.ragged(begin[long], (end - begin)[long])
            word = np.arange(len(words)) - np.searchsorted(doc, np.arange(n))[doc]
            run = np.repeat(np.arange(long.sum()), (end - begin)[long])
            self.parts.append((number[at], run, doc[at] + self.docs, (starts - offsets[doc])[at], (ends - offsets[doc])[at], word[at]))
        self.docs += n
        self.bytes += len(data)

    def search(self) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
        """n_words, n_hit, spans (doc, from byte, to byte, from word, to word) and (doc, item) pairs, each in order of documents."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        symbols = np.concatenate([p[0] for p in self.parts] or [none])
        if not len(symbols):
            return n_words, np.zeros(self.docs, np.int64), (none, none, none, none, none), (none, none)
        doc, start, end, word = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4, 5))
        shift, runs = 0, []
        for p in self.parts:
            runs.append(p[1] + shift)
            shift += int(p[1][-1]) + 1 if len(p[1]) else 0
        run = np.concatenate(runs)
        text = np.ones(len(symbols) + shift, np.int64)
        place = np.arange(len(symbols)) + run  # a mark after each run
        text[place] = symbols
        back = np.full(len(text), -1, np.int64)
        back[place] = np.arange(len(symbols))
        w = self.windows
        index = FMIndex(text, len(w.vocabulary) + _FIRST)
        low, high = index.intervals(w.patterns, w.lengths)
        counts = high - low
        pattern = np.repeat(np.arange(len(counts)), counts)
        at = back[index.locate(bk.ragged(low, counts))]
        cover = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + w.lengths[pattern], -1)
        hit = np.cumsum(cover[:-1]) > 0
        n_hit = np.bincount(doc[hit], minlength=self.docs)
        joined = np.concatenate(([False], (run[1:] == run[:-1]) & hit[:-1]))
        first = np.flatnonzero(hit & ~joined)
        last = np.flatnonzero(hit & ~np.concatenate((joined[1:] & hit[1:], [False])))
        owners = bk.ragged(w.owner_first[pattern], w.owner_first[pattern + 1] - w.owner_first[pattern])
        docs = np.repeat(doc[at], w.owner_first[pattern + 1] - w.owner_first[pattern])
        pairs = np.unique(docs * np.int64(len(w.names)) + w.owners[owners]) if len(owners) else none
        return n_words, n_hit, (doc[first], start[first], end[last], word[first], word[last] + 1), (pairs // max(1, len(w.names)), pairs % max(1, len(w.names)))


def _lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)), values)


def _search(batches: Iterator[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    windows = shared.value
    shard, rows = Shard(windows), []

    def flush() -> Iterator[pa.RecordBatch]:
        n_words, n_hit, (sdoc, *ends), (idoc, item) = shard.search()
        spans = _lists(sdoc, shard.docs, pa.StructArray.from_arrays([pa.array(e) for e in ends], ["lo", "hi", "first", "after"]))
        items = _lists(idoc, shard.docs, pa.array(windows.names, pa.string()).take(pa.array(item)) if windows.names else pa.array([], pa.string()))
        at = 0
        for batch in rows:
            n = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words[at : at + n]), pa.array(n_hit[at : at + n]), spans.slice(at, n), items.slice(at, n)], names=names)
            at += n

    for batch, data, offsets in bk.chunks(batches, "text"):
        shard.add(data, offsets)
        rows.append(batch)
        if shard.bytes >= SHARD_BYTES:
            yield from flush()
            shard, rows = Shard(windows), []
    if rows:
        yield from flush()


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Windows]:
    """The items in blocks of bounded size; one partition at a time comes to the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(quoted(item)).cast("string").alias("i"), F.col(quoted(text)).cast("string").alias("t")).toLocalIterator():
        block.append((row["i"] or "", row["t"]))
        size += 1 + len(row["t"] or "") // 2
        if size >= BLOCK_WINDOWS:
            yield Windows(block, window)
            block, size = [], 0
    if block:
        yield Windows(block, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: Sequence[str] | None = None) -> DataFrame:
    """(doc, n_words, n_hit, spans: merged byte ranges of hits, items: sorted ids with an occurring window)."""
    context = docs.sparkSession.sparkContext
    rows = carried(docs, text, carry)
    found = T._parse_datatype_string(f"n_words long, n_hit long, spans {_SPANS}, items array<string>")

    def searched(rows: DataFrame, shared) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, *found.fields])
        return rows.mapInArrow(partial(_search, shared=shared, names=schema.names), schema)

    blocks = _blocks(benchmark, item, item_text, window)
    block, after = next(blocks, Windows([], window)), next(blocks, None)
    if after is None:
        return searched(rows, context.broadcast(block)).select("doc", "n_words", "n_hit", _bytes(F.col("spans")).alias("spans"), "items")
    scratch, hits = Scratch(docs.sparkSession, "benchmark"), []
    rows = scratch.keep(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    while block is not None:
        shared = context.broadcast(block)
        hits.append(scratch.keep(searched(rows.select("at", "text"), shared).filter(F.size("items") > 0).select("at", "spans", "items"), f"hits-{len(hits)}"))
        shared.destroy()
        block, after = after, next(blocks, None)
    hit = reduce(DataFrame.unionByName, hits).groupBy("at").agg(
        _merged(F.array_sort(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["first"].alias("first"), s["after"].alias("after"), s["lo"].alias("lo"), s["hi"].alias("hi"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    out = rows.select("doc", "at", F.coalesce(F.size(_words(F.col("text"))), F.lit(0)).cast("long").alias("n_words")).join(hit.hint("merge"), "at", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    none = F.array()
    return out.select(
        "doc", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce(_bytes(F.col("spans")), none.cast("array<struct<lo:long,hi:long>>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"),
    )


def _bytes(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _merged(spans: Column) -> Column:
    """Sorted spans with those of neighbouring or shared words joined."""

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        far = F.struct(last["first"].alias("first"), F.greatest(last["after"], s["after"]).alias("after"), last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(far))
        return F.when((F.size(out) > 0) & (last["after"] >= s["first"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<first:long,after:long,lo:long,hi:long>>"), step)


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """A document is contaminated when at least one word in `share` is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)

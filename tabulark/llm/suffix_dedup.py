"""Removal of every byte that a string of LENGTH bytes covers which also starts elsewhere.

The whole of all texts is never sorted.  Of each window of LENGTH bytes the least hashed
GRAM-byte string, the leftmost if equal, is its anchor; equal windows have equal anchors at
the same offset.  So repeats can only be where an anchor's hash is found again, and for
each such anchor one slice of text holds all its windows.

Equal slices are counted by hash: all their windows are repeats.  Of the others, one of
each content goes to the group of its anchor, where their suffixes from the anchor are
ordered by deep-shallow sorting.  Intervals of the sorted suffixes with a common prefix, and
the longest common suffixes before the anchor inside them, give the maximal matches.

A group of more than GROUP slices is split by the part that all its windows of some
offsets have in common, down to single windows, so no group has to fit in a task.

Defined cases: a null text is empty; rows alike in id and text are repeats of each
other; texts under LENGTH bytes stay whole; a null id is a value like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_kernel as bk
from .arrow_rows import quoted
from .scratch import Scratch
from .suffix_sort import common_prefix, deep_shallow

LENGTH = 400
GRAM = 48
#: Slices of one group that are sorted together.
GROUP = 1024
#: Offsets in a block when a larger group is split; a last split takes single windows.
BLOCK = 32

_POSITION = np.uint64((1 << 22) - 1)
_PIECE = 3 << 20


def _window_least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by running minima of blocks from both sides."""
    n = len(v)
    full = np.concatenate((v, np.full((-n) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    right = np.minimum.accumulate(full, axis=1).reshape(-1)
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of all windows: piece, place, first and last window start, gram and slice hash; places are in data."""
    n = len(data)
    valid = np.zeros(n + 1, np.int64)
    full = offsets[1:] - offsets[:-1] >= length
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("piece", "at", "lo", "hi", "h", "sh")}
    sums = bk.Prefix(data)
    p = np.arange(n - gram + 1)
    h = sums.hash(p, p + gram)
    at = (_window_least((h & ~_POSITION) | p.astype(np.uint64), length - gram + 1)[starts] & _POSITION).astype(np.int64)
    piece = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    lo, hi = starts[first], starts[last]
    return {"piece": piece[first], "at": at[first], "lo": lo, "hi": hi, "h": h[at[first]].view(np.int64), "sh": sums.hash(lo, hi + length).view(np.int64)}


def _pieces(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of documents, long ones in overlapping pieces, with their document."""
    lo, hi, doc = [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a > _PIECE:
            lo.append(a)
            hi.append(a + _PIECE)
            doc.append(i)
            a += _PIECE - length + 1
        lo.append(a)
        hi.append(b)
        doc.append(i)
    return np.array(lo), np.array(hi), np.array(doc)


def _find(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of anchors; equal slices of one document stay once (twice = true), the others as direct spans."""
    for batch, data, offsets in bk.chunks(batches, "text"):
        if len(data) > _PIECE:
            lo, hi, doc = _pieces(offsets, length)
            parts = [(data[a:b], np.array([0, b - a]), np.array([d]), np.array([a - offsets[d]])) for a, b, d in zip(lo, hi, doc)]
        else:
            parts = [(data, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64) - offsets[:-1])]
        for part, bounds, doc, shift in parts:
            x = anchors(part, bounds, length)
            piece = x["piece"]
            key = x["sh"].view(np.uint64) ^ bk.mix(doc[piece].astype(np.uint64)) ^ (x["h"].view(np.uint64) * bk.STEPS[40])
            _, first, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            kept = np.zeros(len(key), bool)
            kept[first] = True
            again = n[of] > 1
            own, move = doc[piece], shift[piece]
            columns = [
                batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)),
                pa.array(x["at"] + move), pa.array(x["lo"] + move), pa.array(x["hi"] + move), pa.array(x["h"]), pa.array(x["sh"]), pa.array(again), pa.array(~kept),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "at", "lo", "hi", "h", "sh", "twice", "direct"])


def matches(left: list[bytes], right: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Ranges around the anchor (bytes before and after it) of each slice that another one matches for `length` bytes.

    left: the bytes before the anchor, backwards; right: those from the anchor on.
    """
    n = len(left)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:
        d, b = common_prefix(*right), common_prefix(*left)
        if b + d >= length:
            out[0].append((b, d))
            out[1].append((b, d))
        return out
    known = GRAM if len({r[:GRAM] for r in right}) == 1 else 0
    order, lcp = deep_shallow(right, known)
    back_rank = [0] * n
    for rank, i in enumerate(deep_shallow(left)[0]):
        back_rank[i] = rank

    def meet(first: int, end: int, depth: int) -> None:
        """All suffixes order[first:end] share `depth` bytes: match their nearest texts before the anchor."""
        group = sorted(order[first:end], key=back_rank.__getitem__)
        before = 0
        for k, i in enumerate(group):
            after = common_prefix(left[i], left[group[k + 1]]) if k + 1 < len(group) else 0
            best = max(before, after)
            if best + depth >= length:
                out[i].append((best, depth))
            before = after

    # Intervals of suffixes with a common prefix, each when it ends.
    open_: list[tuple[int, int]] = []
    for k in range(1, n + 1):
        depth = lcp[k] if k < n else -1
        first = k - 1
        while open_ and open_[-1][1] > depth:
            first, d = open_.pop()
            meet(first, k, d)
        if depth >= 0 and (not open_ or open_[-1][1] < depth):
            open_.append((first, depth))
    return out


def _sorted_group(part: pa.Table, length: int) -> pa.Table:
    left, right = [x[::-1] for x in part.column("left").to_pylist()], part.column("right").to_pylist()
    found = [(i, b, d) for i, own in enumerate(matches(left, right, length)) if own for b, d in own]
    rows = pa.array([i for i, _, _ in found], pa.int64())
    at = np.array(part.column("at"))[np.array(rows)] if len(found) else np.zeros(0, np.int64)
    return pa.table({
        "id": part.column("id").take(rows), "th": part.column("th").take(rows),
        "lo": pa.array(at - np.array([b for _, b, _ in found], np.int64)), "hi": pa.array(at + np.array([d for _, _, d in found], np.int64)),
    })


def repeated_spans(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, th, lo, hi): byte ranges that repeated strings cover, of documents by id and text hash."""
    rows = docs.select(F.col(quoted(key)).alias("id"), F.xxhash64(quoted(text)).alias("th"), F.col(quoted(text)).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = scratch.keep(
        rows.filter(F.octet_length("text") >= length).mapInArrow(lambda b: _find(b, length), f"id {kind}, th long, at long, lo long, hi long, h long, sh long, twice boolean, direct boolean"), "anchors"
    )
    direct = found.filter("direct").select("id", "th", "lo", (F.col("hi") + length).alias("hi"))
    again = found.filter("not direct").groupBy("h").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 or twice").select("h")
    # Written before they are joined, so that Spark can split the joins' hot anchors.
    again = scratch.keep(again, "again")
    candidates = found.filter("not direct").join(again.hint("merge"), "h", "left_semi").withColumns({"before": F.col("at") - F.col("lo"), "after": F.col("hi") - F.col("at")})
    candidates = scratch.keep(candidates, "candidates")
    content = ["h", "sh", "before", "after"]
    slices = candidates.groupBy(*content).agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("id", "th", "at", "lo", "hi")).alias("r"))
    slices = scratch.keep(slices.withColumn("repeats", (F.col("n") > 1) | F.col("twice")), "slices")
    whole = candidates.join(slices.filter("repeats").select(*content).hint("merge"), content, "left_semi").select("id", "th", "lo", (F.col("hi") + length).alias("hi"))
    sizes = scratch.keep(slices.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    wanted = slices.join(sizes.hint("merge"), "h").select("r.*", F.col("h").alias("g"), "m")
    by_doc = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("at", "lo", "hi", "g", "m")).alias("cuts"))
    texts = rows.join(by_doc.select(F.col("id").alias("cid"), F.col("th").alias("cth"), "cuts").hint("merge"), F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")))
    body, cut = F.col("text").cast("binary"), F.col("cut")
    # Rows alike in id and text have equal slices, so one of them is enough.
    cuts = texts.dropDuplicates(["id", "th"]).select("id", "th", "text", F.explode("cuts").alias("cut")).select(
        "id", "th", cut["at"].alias("at"), cut["g"].alias("g"), cut["m"].alias("m"),
        F.substr(body, (cut["lo"] + 1).cast("int"), (cut["at"] - cut["lo"]).cast("int")).alias("left"),
        F.substr(body, (cut["at"] + 1).cast("int"), (cut["hi"] + length - cut["at"]).cast("int")).alias("right"),
    )
    parts = scratch.keep(cuts, "parts")
    scratch.release_shuffles()
    spans = [direct, whole]
    span = T._parse_datatype_string(f"id {kind}, th long, lo long, hi long")
    step, size = 0, BLOCK
    while True:
        small = parts.filter(F.col("m") <= GROUP)
        spans.append(small.groupBy("g").applyInArrow(lambda part: _sorted_group(part, length), span))
        large = parts.filter(F.col("m") > GROUP)
        if large.isEmpty():
            break
        blocks = F.sequence(F.lit(0), F.floor(F.octet_length("left") / size).cast("int"))
        split = large.select("id", "th", "at", "g", "left", "right", F.explode(blocks).alias("o")).select(
            "id", "th", "at", "g", "left", "right", (F.col("o") * size).alias("o1"), F.least(F.col("o") * size + size - 1, F.octet_length("left")).alias("o2")
        ).filter(F.octet_length("right") >= length - F.col("o2"))
        core = F.concat(F.substr("left", F.octet_length("left") - F.col("o1") + 1, F.col("o1")), F.substr("right", F.lit(1), F.lit(length) - (F.col("o1") + size - 1)))
        own = F.xxhash64("g", "o1", core)
        if size == 1:
            single = scratch.keep(split.select("id", "th", (F.col("at") - F.col("o1")).alias("lo"), own.alias("g"), F.xxhash64(core, F.lit(3)).alias("c")), f"single-{step}")
            twice = single.groupBy("g", "c").agg(F.count("*").alias("n")).filter("n > 1").select("g", "c")
            spans.append(single.join(twice.hint("merge"), ["g", "c"], "left_semi").select("id", "th", "lo", (F.col("lo") + length).alias("hi")))
            break
        cut_ = split.select(
            "id", "th", "at", own.alias("g"),
            F.substr("left", F.octet_length("left") - F.col("o2") + 1, F.col("o2")).alias("left"),
            F.substr("right", F.lit(1), F.lit(length) - F.col("o1")).alias("right"),
        )
        cut_ = scratch.keep(cut_, f"split-{step}")
        counts = cut_.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
        parts = scratch.keep(cut_.join(counts.hint("merge"), "g"), f"parts-{step}")
        scratch.drop(f"split-{step}")
        step, size = step + 1, 1
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in bk.chunks(batches, "text"):
        n = len(batch)
        lists = batch.column(batch.schema.get_field_index("spans"))
        cover = np.zeros(len(data) + 1, np.int64)
        flat, doc = lists.flatten(), np.repeat(np.arange(n), np.array(lists.value_lengths().fill_null(0)))
        if len(flat):
            np.add.at(cover, np.array(flat.field("lo")) + offsets[doc], 1)
            np.add.at(cover, np.array(flat.field("hi")) + offsets[doc], -1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        edge[starts] = gone[starts]
        removed, runs = (np.concatenate(([0], np.cumsum(x))) for x in (gone, edge))
        kept = np.ascontiguousarray(data[~gone])
        at = (offsets - removed[offsets]).astype(np.int64)
        blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(kept)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(runs[offsets])), blob], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: Sequence[str] | None = None) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept: the remaining bytes) for every row."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, scratch, key, text, length)
    spans = scratch.keep(spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.drop("anchors", "again", "candidates", "slices", "sizes", "parts")
    scratch.release_shuffles()
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in (docs.columns if carry is None else carry)]).alias("doc"),
        F.col(quoted(key)).alias("id"), F.xxhash64(quoted(text)).alias("th"), F.col(quoted(text)).cast("string").alias("text"),
    )
    joined = rows.join(spans.select(F.col("id").alias("cid"), F.col("th").alias("cth"), "spans").hint("merge"), F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
    schema = T.StructType([rows.schema["doc"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary").fields])
    return joined.select("doc", "text", "spans").mapInArrow(_apply, schema)

"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles.

Texts are lower-cased (A-Z) and cut into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; a shingle is five of them (a shorter text is one
shingle).  A shingle weighs its count in the text times its inverse document frequency,
which is clipped: all shingles in fewer than one document in RARE weigh alike, as otherwise what the members of a large
group of near copies share would weigh less than each one's own edits.  So only the frequent shingles need a table.  One
pass counts documents by buckets of shingle hashes, a second one counts the shingles of those buckets that reach the
frequency; the table is exact and the same however rows are dealt.

Each distinct word sequence is one node.  BANDS x ROWS weighted samples of a node make its band
keys; the draws of a sample come from a table of 65 536 entries that shingle hashes look up.  Buckets of the same nodes are one.
First each node meets one centre of its buckets, which joins most members of large groups of copies.  Then
every bucket whose nodes are of several components is compared in whole: its nodes meet in blocks of bounded size, and
every pair of different components is verified by weighted Jaccard similarity, once, in the first bucket that it shares, unless both
were joined meanwhile or their total weights alone rule it out.  The nodes of the largest component of a bucket don't meet each
other.  Components are labelled in distributed steps; nothing but counts and the bounded table of frequent shingles reaches the driver.

Defined cases: null and empty texts are classes of their own; other texts without words are one class if they are equal;
equal word sequences are one class; a null id is a value like others, the least; rows alike in id and text are
one document repeated, of which one row is kept; other columns, whatever their names, are carried in `doc`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes_kernel as bk
from .arrow_rows import carried, quoted
from .scratch import Scratch

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Shingles in fewer than one document in RARE have the same, greatest, inverse document frequency.
RARE = 20
#: Buckets of shingle hashes that documents are counted by to find the frequent ones.
COUNT_BITS = 19
#: Frequent shingles are counted in runs of so many.
RUN = 1 << 20
#: Inverse document frequencies are rounded to this, so that few different weights occur.
GRAIN = 1 / 32
LEAST_IDF = 1 / 16
#: Nodes and words of a block of a bucket's nodes that are compared together.
PART, PART_WORDS = 1024, 400_000
#: Repeated documents (their ids, hashes and classes) of so many bytes are sent to where the rows are read; more are joined by shuffles.
SENT_BYTES = 16 << 20

_TABLE_BITS = 16
_RNG = np.random.default_rng(41)
#: Draws of the sampling: r and c are Gamma(2, 1), beta is uniform.
_R = _RNG.gamma(2.0, 1.0, 1 << _TABLE_BITS).astype(np.float32) + np.float32(1e-6)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, 1 << _TABLE_BITS)).astype(np.float32)
_BETA = _RNG.uniform(0.0, 1.0, 1 << _TABLE_BITS).astype(np.float32)
_SAMPLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and documents of all shingles, in order of documents, and a 128-bit hash of each word sequence."""
    n = len(offsets) - 1
    starts, ends, doc = bk.runs(data, offsets, bk.PLAIN_WORD)
    words = bk.Prefix(data, fold=True).hash(starts, ends)
    h, at = bk.window_hash(words, doc, SHINGLE)
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    of = doc[at]
    content = [bk.sequence_hash(words, first, salt) for salt in bk.STEPS[60:62]]
    if len(short):
        h, of = np.concatenate((h, content[0][short])), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of, np.stack(content), counts


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct shingles with their counts, in order of documents."""
    key = h ^ bk.mix(doc.astype(np.uint64))
    order = np.lexsort((key, doc)) if len(doc) < 1 << 16 else np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    tf = np.diff(np.append(first, len(key)))
    at = order[first]
    back = np.argsort(doc[at], kind="stable")
    return h[at[back]], doc[at[back]], tf[back]


class Frequent:
    """Inverse document frequencies, as shares of the greatest, of the frequent shingles; 1 for all others."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, docs: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        idf = np.log((docs + 1) / (df[order] + 1)) / math.log(RARE)
        self.idf = np.round(np.clip(idf, LEAST_IDF, 1.0) / GRAIN).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def grains(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), round(1 / GRAIN), np.int64)
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            known = self.hashes[place] == h[at]
            out[at[known]] = self.idf[place[known]]
        return out


def draw(log_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """For each table entry: log a, the value whose minimum is sampled, and t, the quantised log weight."""
    t = np.floor(np.float32(log_weight) / _R + _BETA)
    return _LOG_C - _R * (t - _BETA + 1), t.astype(np.int64)


def samples(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """k weighted samples (hashes of shingle and t) of each document; 0 for those without shingles."""
    out = np.zeros((k, n), np.uint64)
    if not len(h):
        return out
    classes, of = np.unique(weight, return_inverse=True)
    tables = [draw(math.log(w * GRAIN)) for w in classes]
    values = np.concatenate([t[0] for t in tables])
    steps = np.concatenate([t[1] for t in tables])
    shift = of.astype(np.int64) << _TABLE_BITS
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    lengths = np.diff(np.append(first, len(doc)))
    own = doc[first]
    for i in range(k):
        entry = ((h * _SAMPLE[i]) >> np.uint64(64 - _TABLE_BITS)).view(np.int64) + shift
        value = values[entry]
        least = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(least, lengths))
        # Of shingles with the same value, the one with the least hash.
        name = bk.mix(h[hit] + steps[entry[hit]].view(np.uint64) * _SAMPLE[i])
        begin = np.flatnonzero(np.concatenate(([True], doc[hit[1:]] != doc[hit[:-1]])))
        out[i, own] = np.minimum.reduceat(name, begin)
    return out


def bands(sampled: np.ndarray, bands_: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each document, (documents, bands)."""
    out = np.empty((sampled.shape[1], bands_), np.uint64)
    for b in range(bands_):
        key = np.full(sampled.shape[1], b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            key = bk.mix(key * bk.STEPS[62] + sampled[i])
        out[:, b] = key
    return out


def weighted_jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], frequent: Frequent) -> np.ndarray:
    """Similarity of the i-th text of left and of right (bytes and offsets)."""
    n = len(left[1]) - 1
    sides = [counted(*shingles(*side)[:2]) for side in (left, right)]
    h = np.concatenate([s[0] for s in sides])
    pair = np.concatenate([s[1] for s in sides])
    weight = np.concatenate([s[2] for s in sides]) * frequent.grains(h)
    key = h ^ bk.mix(pair.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[same], order[same + 1]
    shared = np.bincount(pair[a], np.minimum(weight[a], weight[b]), n)
    total = np.bincount(pair, weight, n) - shared
    return np.where(total > 0, shared / np.where(total > 0, total, 1), 0.0)


def frequent_shingles(docs: DataFrame, text: str, scratch: Scratch) -> Frequent:
    """Exact document frequencies of all shingles in at least one document in RARE."""
    rows = carried(docs, text, []).select("text")
    shift = np.uint64(64 - COUNT_BITS)

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(1 << COUNT_BITS, np.int64)
        for _, data, offsets in bk.chunks(batches, "text"):
            h, doc, *_, words = shingles(data, offsets)
            found += np.bincount((counted(h, doc)[0] >> shift).view(np.int64), minlength=1 << COUNT_BITS)
            n += int((words > 0).sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], names=["bucket", "n"])

    counts = scratch.keep(rows.mapInArrow(by_bucket, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "counts")
    total = counts.filter("bucket < 0").agg(F.sum("n")).first()[0] or 0
    maybe = np.zeros(1 << COUNT_BITS, bool)
    maybe[[r["bucket"] for r in counts.filter((F.col("bucket") >= 0) & (F.col("n") * RARE >= total)).select("bucket").collect()]] = True  # at most 2 ** COUNT_BITS
    wanted = docs.sparkSession.sparkContext.broadcast(maybe)

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size = [], 0

        def summed() -> pa.RecordBatch:
            found, df = np.unique(np.concatenate(run), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(df)], names=["h", "df"])

        for _, data, offsets in bk.chunks(batches, "text"):
            h = counted(*shingles(data, offsets)[:2])[0]
            h = h[wanted.value[(h >> shift).view(np.int64)]]
            run.append(h)
            size += len(h)
            if size >= RUN:
                yield summed()
                run, size = [], 0
        if size:
            yield summed()

    found = rows.mapInArrow(exactly, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).filter(F.col("df") * RARE >= total).collect()  # at most RARE times the mean number of shingles of a document
    return Frequent(np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["df"] for r in found], np.int64), total)


def _node() -> Column:
    return F.struct("a", "b")


def relabel(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels (node, label) after joining the components of linked labels (x, y)."""
    edges = links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    edges = scratch.keep(edges, f"{name}-edges")
    least = edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("to"))
    least = scratch.keep(least, f"{name}-0")
    step = 0
    while True:
        step += 1
        # The least label that a neighbour has, then that label's own label.
        near = edges.join(least.select(F.col("x").alias("y"), "to"), "y").groupBy("x").agg(F.min("to").alias("near"))
        better = least.join(near, "x").select("x", F.least("to", "near").alias("next"), "to")
        jumped = better.join(better.select(F.col("x").alias("next"), F.col("next").alias("far")), "next", "left")
        now = scratch.keep(jumped.select("x", F.least("next", F.coalesce("far", "next")).alias("to"), F.col("to").alias("was")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        least = now.select("x", "to")
        if now.filter("to != was").isEmpty():
            break
    moved = labels.join(least.select(F.col("x").alias("label"), "to"), "label", "left")
    out = scratch.keep(moved.select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")
    scratch.drop(f"{name}-edges", f"{name}-{step}")
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and cell, cut between groups only, in batches of about CHUNK_BYTES of text."""
    rest: list[pa.RecordBatch] = []

    def cuts(batch: pa.RecordBatch) -> np.ndarray:
        key, cell = (np.array(batch.column(batch.schema.get_field_index(c))) for c in ("key", "cell"))
        return np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1

    for batch in batches:
        rest.append(batch)
        joined = pa.Table.from_batches(rest).combine_chunks().to_batches()
        rest = joined
        if len(joined) != 1:
            continue
        at = cuts(joined[0])
        if not len(at):
            continue
        size = np.concatenate(([0], np.cumsum(np.array(pc.binary_length(joined[0].column("text"))))))
        begin = 0
        for this, after in zip(at, [*at[1:], None]):
            if after is None or size[after] - size[begin] > bk.CHUNK_BYTES:
                yield joined[0].slice(begin, this - begin)
                begin = this
        rest = [joined[0].slice(begin)]
    yield from rest


def links_in_groups(batch: pa.RecordBatch, frequent: Frequent, similarity: float) -> list[tuple[int, int]]:
    """Rows of a batch (whole groups) to be joined: a spanning part of all similar pairs of a group.

    A group's rows of side 1 meet those of side 0 only; without such rows all meet each other.
    """
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    n = len(batch)
    h, doc, tf = counted(*shingles(*bk.utf8(column("text")))[:2])
    weight = tf * frequent.grains(h)
    name = np.unique(h, return_inverse=True)[1]
    first = np.searchsorted(doc, np.arange(n + 1))
    total = np.bincount(doc, weight, n).astype(np.int64)
    labels = np.stack([np.array(column("label").field(c)) for c in ("a", "b")], axis=1)
    part = np.unique(np.ascontiguousarray(labels).view("i8,i8").reshape(-1), return_inverse=True)[1].reshape(-1)
    keys = np.array(column("keys").flatten()).reshape(n, -1)
    key, cell, side, band = (np.array(column(c)) for c in ("key", "cell", "side", "band"))
    held = np.zeros(int(name.max()) + 1 if len(name) else 0, np.int64)
    edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1, [n]))
    out: list[tuple[int, int]] = []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        apart, k = bool(side[begin:end].any()), band[begin]
        for i in range(begin, end - 1):
            after = slice(i + 1, end)
            meets = (part[after] != part[i]) & (np.minimum(total[after], total[i]) >= np.maximum(total[after], total[i]) * (similarity * (1 - 1e-9)))
            if apart:
                meets &= side[after] != side[i]
            other = np.flatnonzero(meets) + i + 1
            if len(other):  # the first band that two nodes share
                other = other[(keys[other] == keys[i]).argmax(1) == k]
            if not len(other):
                continue
            own = slice(first[i], first[i + 1])
            held[name[own]] = weight[own]
            sizes = first[other + 1] - first[other]
            at = bk.ragged(first[other], sizes)
            both = np.minimum(held[name[at]], weight[at])
            shared = np.add.reduceat(both, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            held[name[own]] = 0
            for j in other[shared / (total[other] + total[i] - shared) >= similarity].tolist():
                if part[j] != part[i]:
                    out.append((i, j))
                    part[begin:end][part[begin:end] == part[j]] = part[i]
            if (part[begin:end] == part[i]).all():
                break
    return out


def open_cells(left: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of left (key, band, node, words, label) in buckets of several components, as often as a bucket's blocks meet, with cell and side."""
    sizes = left.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "w", "label")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter("most.n < n")
    blocks = lambda n, w: F.ceil(F.greatest(n / PART, w / PART_WORDS)).cast("long")
    together = blocks(F.col("n"), F.col("w")) <= 1
    sizes = sizes.select(
        "key", F.when(~together, F.col("most.label")).alias("most"),
        F.when(together, 1).otherwise(blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w"))).alias("few"),
        F.when(together, 0).otherwise(blocks(F.col("most.n"), F.col("most.w"))).alias("many"),
    )
    rows = left.join(scratch.keep(sizes, "open").hint("merge"), "key")  # written first, so that Spark can split hot buckets
    large = F.coalesce(F.col("label") == F.col("most"), F.lit(False))
    block = F.pmod(F.xxhash64("node"), F.when(large, F.col("many")).otherwise(F.col("few")))
    # Blocks of other nodes are 0 to few - 1; then come those of the largest component.
    rows = rows.withColumns({"large": large, "block": F.when(large, F.col("few") + block).otherwise(block)})
    met = F.when(F.col("large"), F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("few") + F.col("many") - 1))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.withColumn("other", F.explode(met)).select(
        "key", "band", "node", "label", (low * (F.col("few") + F.col("many")) + high).alias("cell"), ((low != high) & (F.col("block") == high)).cast("int").alias("side")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, carry: Sequence[str] | None = None) -> DataFrame:
    """(doc, class_id: the least id of the class, keep: true for one row of each class)."""
    scratch = Scratch(docs.sparkSession, "near")
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(frequent_shingles(docs, text, scratch))
    rows = docs.select(F.col(quoted(key)).alias("id"), F.xxhash64(quoted(text)).alias("th"), F.col(quoted(text)).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in bk.chunks(batches, "text"):
            h, doc, content, words = shingles(data, offsets)
            for i in np.flatnonzero((words == 0) & (offsets[1:] > offsets[:-1])):
                digest = xxhash.xxh3_128_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
                content[:, i] = digest >> 64, digest & ((1 << 64) - 1)
            h, doc, tf = counted(h, doc)
            weight = tf * frequent.value.grains(h)
            keys = bands(samples(h, doc, weight, len(words), BANDS * ROWS), BANDS, ROWS)[words > 0]
            total = pa.array(np.bincount(doc, weight, len(words)).astype(np.int64))
            ends = np.concatenate(([0], np.cumsum(words > 0))).astype(np.int32) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            filled = pa.array(offsets[1:] > offsets[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), filled, *[pa.array(c.view(np.int64)) for c in content], pa.array(words), total, lists], names=["id", "th", "filled", "a", "b", "words", "weight", "keys"])

    id_type = rows.schema["id"].dataType.simpleString()
    signed = scratch.keep(rows.mapInArrow(sign, f"id {id_type}, th long, filled boolean, a long, b long, words long, weight long, keys array<long>"), "signed")
    filled = signed.filter("filled")
    nodes = filled.filter("words > 0").groupBy("a", "b").agg(F.min(F.struct("id", "th", "weight", "words", "keys")).alias("m")).select(_node().alias("node"), "m.*")
    nodes = scratch.keep(nodes, "nodes")
    places = nodes.select("node", "weight", "words", F.posexplode("keys").alias("band", "key"))
    # Buckets of the same nodes, which are told by their number and hashes, are one: that of the first band.
    alike = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"), F.min("band").alias("band")]
    full = places.groupBy("key").agg(*alike).filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.key")
    buckets = scratch.keep(places.join(full.hint("merge"), "key"), "buckets")
    members = nodes.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = scratch.keep(
        rows.join(members.withColumnsRenamed({"id": "mid", "th": "mth"}).hint("merge"), F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")))
        .select("node", "keys", "text").dropDuplicates(["node"]),
        "texts",
    )
    scratch.drop("nodes")
    scratch.release_shuffles()
    labels = texts.select("node", F.col("node").alias("label"))
    node_type = labels.schema["node"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *left in bk.chunks(batches, "text"):
            right = bk.utf8(batch.column(batch.schema.get_field_index("other")))
            alike = weighted_jaccard(tuple(left), right, frequent.value) >= similarity
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(alike)), batch.column(1).filter(pa.array(alike))], names=["x", "y"])

    # Each node and one centre: the least node of its buckets.
    centres = buckets.groupBy("key").agg(F.min(F.struct("node", "weight")).alias("c"))
    # The lesser total weight is all that two texts can share, the greater is the least they have together.
    fits = F.least("weight", "c.weight") >= F.greatest("weight", "c.weight") * (similarity * (1 - 1e-9))
    met = buckets.join(centres.hint("merge"), "key").filter((F.col("node") != F.col("c.node")) & fits).groupBy("node").agg(F.min("c.node").alias("centre"))
    pairs = met.join(texts.select("node", "text").hint("merge"), "node").join(texts.select(F.col("node").alias("centre"), F.col("text").alias("other")).hint("merge"), "centre")
    links = scratch.keep(pairs.select("node", "centre", "text", "other").mapInArrow(verify, f"x {node_type}, y {node_type}"), "links-0")
    labels = relabel(labels, links, scratch, "first")
    scratch.release_shuffles()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            found = np.array(links_in_groups(batch, frequent.value, similarity), np.int64).reshape(-1, 2)
            label = batch.column(batch.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays([label.take(pa.array(found[:, 0])), label.take(pa.array(found[:, 1]))], names=["x", "y"])

    # Then all pairs of different components in the buckets that still have any.
    cells = open_cells(buckets.join(labels.hint("merge"), "node"), scratch)
    bodies = cells.join(texts.hint("merge"), "node").select("key", "cell", "side", "band", "label", "keys", "text")
    bodies = bodies.repartition("key", "cell").sortWithinPartitions("key", "cell")
    links = scratch.keep(bodies.mapInArrow(link, f"x {node_type}, y {node_type}"), "links-1")
    labels = relabel(labels, links, scratch, "second")
    scratch.drop("counts", "buckets", "open", "texts", "links-0", "links-1", "first-labels")
    scratch.release_shuffles()
    named = filled.select("id", "th", _node().alias("node")).join(labels.hint("merge"), "node", "left")
    named = scratch.keep(named.select("id", "th", F.coalesce("label", "node").alias("label")), "named")
    # Written before it is joined, so that Spark can split the join's hot labels.
    heads = scratch.keep(named.groupBy("label").agg(F.min(F.struct("id", "th")).alias("head")), "heads")
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))  # a null id is one like others
    alike = named.join(heads.hint("merge"), "label").select("id", "th", "head")
    blank = signed.filter("NOT filled").select("id", "th", F.lit(None).cast(alike.schema["head"].dataType).alias("head"))
    # Rows alike in id and text are counted by a combined aggregate and written, so that Spark can split those of one document in the join.
    classes = scratch.keep(alike.unionByName(blank).groupBy(name.alias("name"), "th").agg(F.first("head", True).alias("head"), F.count("*").alias("n")), "classes")
    scratch.drop("signed", "second-labels", "named", "heads")
    out = docs.select(
        F.struct(*[F.col(quoted(c)) for c in (docs.columns if carry is None else carry)]).alias("doc"), F.col(quoted(key)).alias("id"), F.xxhash64(quoted(text)).alias("th")
    ).withColumn("name", name)
    head = F.coalesce("head", F.struct("id", "th"))
    chosen = head["id"].eqNullSafe(F.col("id")) & (head["th"] == F.col("th"))
    found = out.join(classes.hint("merge"), ["name", "th"]).filter("n = 1").select("doc", head["id"].alias("class_id"), chosen.alias("keep"))
    several = classes.filter("n > 1")
    size = several.agg(F.sum(2 * F.octet_length("name") + 64)).first()[0]
    if size is None:
        return found
    # One of several rows alike is that of the least place in a written table of them; nothing gathers them in one task.
    several = F.broadcast(several) if size <= SENT_BYTES else several.hint("merge")
    rows = out.join(several, ["name", "th"]).select("name", "th", "doc", head["id"].alias("class_id"), chosen.alias("keep"), F.monotonically_increasing_id().alias("place"))
    rows = scratch.keep(rows, "several")
    first = scratch.keep(rows.groupBy("name", "th").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first")), "first")
    rows = rows.join(first.hint("merge"), "place", "left")
    return found.unionByName(rows.select("doc", "class_id", (F.col("keep") & F.col("first").isNotNull()).alias("keep")))

"""Consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on the ring and belongs to the next virtual node clockwise.  A
shard takes its keys in ring order up to its capacity; what overflows continues
clockwise to the next virtual node whose shard has room.  With `slack=0` the capacities
are floor(n / shards) or one more and add up to n, so row counts are at most one apart.

Only the counts per arc (shards x virtual nodes of them, whatever the data) reach the
driver, which plans the overflow there; rows are then dealt by their rank in their arc.  Ranks come from one sort of all rows by arc, place,
key and content: Spark deals it out by ranges, down to single rows, so a key that a third of all rows have doesn't meet in one task, and
the rank of a row depends on keys and contents only, at every size and however the table is split.

Defined cases: a null key has one place like any other; repeated rows rank after each
other; a null text has 0 bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import quoted
from .scratch import Scratch

VIRTUAL_NODES = 128
_M = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def ring(shards: int, virtual: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """Sorted places (signed 64 bit) and the shard at each; a shard's places don't depend on the number of shards."""
    nodes = sorted((_mixed(_mixed(shard) ^ node) - (1 << 63), shard) for shard in range(shards) for node in range(virtual))
    return [p for p, _ in nodes], [s for _, s in nodes]


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [math.ceil(rows * (1 + slack) / shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def plan(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, from rank, to rank, shard, first slot) for the counts per arc.

    Arcs first fill their own shard in ring order; leftovers then walk clockwise.  A
    pointer skips full shards, so a walk costs the nodes it passes.
    """
    room, slots, out, left = list(capacity), [0] * len(capacity), [], []

    def take(arc: int, start: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            out.append((arc, start, start + got, shard, slots[shard]))
            room[shard] -= got
            slots[shard] += got
        return got

    for arc in sorted(counts):
        got = take(arc, 0, counts[arc], owners[arc])
        if got < counts[arc]:
            left.append((arc, got))
    skip = list(range(1, len(owners) + 1))
    for arc, start in left:
        at = (arc + 1) % len(owners)
        while start < counts[arc]:
            start += take(arc, start, counts[arc] - start, owners[at])
            path = []
            while not room[owners[at]] and start < counts[arc]:
                path.append(at)
                at = skip[at] % len(owners)
            for p in path:
                skip[p] = at if at > p else at + len(owners)
    return out


def arc_of(place: Column, places: list[int]) -> Column:
    """The index of the next virtual node clockwise of a place."""
    nodes = np.array(places, np.int64)

    @F.pandas_udf("int")
    def clockwise(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(nodes, place.to_numpy(np.int64)) % len(nodes)).astype(np.int32))

    return clockwise(place)


def owner(place: int, places: list[int], owners: list[int]) -> int:
    return owners[bisect_left(places, place) % len(owners)]


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", virtual: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """(key, size, text_crc32, shard, slot, moved) for every row; moved: not in its arc's own shard."""
    places, owners = ring(shards, virtual)
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(quoted(key)).alias("key"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(quoted(key)).cast("string"), F.lit(1)).alias("place"),
        F.monotonically_increasing_id().alias("at"),
    )
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.keep(rows.withColumn("arc", arc_of(F.col("place"), places)), "rows")
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # a row an arc
    total = sum(counts.values())
    segments = plan(counts, owners, capacities(total, shards, slack)) or [(0, 0, 0, 0, 0)]
    dealt = docs.sparkSession.createDataFrame(segments, "arc int, lo long, hi long, shard int, first long")
    # The place of a row in the sorted table, less that of its arc's first row.  The sort is written, so it is made once.
    ordered = rows.orderBy("arc", "place", "key", "text_crc32", "size", "at").withColumn("nth", F.monotonically_increasing_id())
    ordered = scratch.keep(ordered.drop("at"), "ordered")
    part, within = F.shiftright("nth", 33), F.col("nth").bitwiseAND((1 << 33) - 1)
    before, starts, arcs = 0, [], []
    for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        starts.append((r["part"], before))
        before += r["n"]
    before = 0
    for arc, own in enumerate(owners):
        arcs.append((arc, own, before))
        before += counts.get(arc, 0)
    starts = docs.sparkSession.createDataFrame(starts, "part long, start long")
    arcs = docs.sparkSession.createDataFrame(arcs, "arc int, own int, arc_start long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part").join(F.broadcast(arcs), "arc").withColumn("rank", F.col("start") + within - F.col("arc_start"))
    return (
        ranked.join(F.broadcast(dealt), "arc")  # at most a segment for each arc and shard filled
        .filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), (F.col("own") != F.col("shard")).alias("moved"))
    )

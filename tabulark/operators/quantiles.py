"""Exact quartiles of groups of any size, without bringing a large group's values to one task.

Groups of up to SMALL values are sorted each as one array.  Larger ones, which are no more than all values / SMALL, take radix
selection: values are counted by group and bucket, an order-preserving coarse code of the value.  The buckets that hold a quartile's neighbours are known from these counts.  Where
one holds over SMALL values, however narrow they lie, it is divided into CELLS parts of its range, and these again, until what is left to
rank is small or all alike.  A third of all rows may be one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch_path

POINTS = {"p25": 0.25, "median": 0.5, "p75": 0.75}
#: Buckets for each doubling of a value.
STEPS = 256
#: What has more values is divided, buckets into CELLS parts.
SMALL, CELLS = 1 << 16, 1 << 12


def bucket(value: Column) -> Column:
    """Greater or equal for greater values: the logarithm of the size, zero between negative and positive ones."""
    size = F.floor(F.log2(F.abs(value)) * STEPS)
    return F.when(value > 0, size).when(value == 0, F.lit(-(1 << 24))).otherwise(F.lit(-(1 << 25)) - size)


def _low() -> dict[str, Column]:
    """The rank below each quartile; the next one is the same or above."""
    return {name: F.floor((F.col("n") - 1) * p) for name, p in POINTS.items()}


def _wanted() -> Column:
    """Whether a part, of `c` values with `before` below it, holds a quartile's neighbour."""
    out = F.lit(False)
    for rank in _low().values():
        for r in (rank, rank + 1):
            out = out | ((r >= F.col("before")) & (r <= F.col("before") + F.col("c") - 1))
    return out


def _divided(x: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of large ones that hold a quartile's neighbours; there are no more large ones than values / SMALL, so they are sent to the rows."""
    own = x.join(F.broadcast(large.select(*keys, "bucket", "lo", "hi", "before", "n")), [*keys, "bucket"]).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    cell = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)
    counts = own.groupBy(*keys, "bucket", F.col("lo").alias("floor"), cell.alias("cell")).agg(
        F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("before").alias("base"), F.first("n").alias("n")
    )
    upto = F.sum("c").over(Window.partitionBy(*keys, "bucket", "floor").orderBy("cell"))
    return counts.withColumn("before", F.col("base") + upto - F.col("c")).filter(_wanted()).select(*large.columns)


def chosen_parts(x: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """(keys, bucket, c, lo, hi, before, n): the parts, of values lo to hi of a bucket, that hold a quartile's neighbours: six a group at most.

    They are made here and now; few: those of all groups fit in the driver.
    """
    keep = (lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)) if few else _written
    sizes = x.groupBy(*keys, "bucket").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    own = Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "bucket", "c", "lo", "hi", (F.sum("c").over(own.orderBy("bucket")) - F.col("c")).alias("before"), F.sum("c").over(own).alias("n"))
    parts = keep(sizes.filter(_wanted()))
    is_large = (F.col("c") > SMALL) & (F.col("lo") < F.col("hi"))
    while not (large := parts.filter(is_large)).isEmpty():
        parts = keep(parts.filter(~is_large).unionByName(_divided(x, large, keys)))
    return parts


def _written(df: DataFrame) -> DataFrame:
    where = scratch_path(df.sparkSession, "parts")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _between(low: Column, high: Column, p: float) -> Column:
    """Linear interpolation between the values at a quartile's neighbouring ranks."""
    return low + F.coalesce((high - low) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)), F.lit(0.0))


def _selected(x: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """By radix selection."""
    x = x.withColumn("bucket", bucket(F.col("v")))
    chosen = chosen_parts(x, keys, few).select(*keys, "bucket", "lo", "hi", "before", "n")
    found = x.join(F.broadcast(chosen) if few else chosen, [*keys, "bucket"]).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    values = found.groupBy(*keys, "lo", "v").agg(F.count("*").alias("c"), F.first("before").alias("before"), F.first("n").alias("n"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "lo").orderBy("v"))
    ranked = values.select(*keys, "v", "n", (upto - F.col("c")).alias("first"), (upto - 1).alias("last"))
    ends = []
    for name, rank in _low().items():
        ends += [F.max(F.when((r >= F.col("first")) & (r <= F.col("last")), F.col("v"))).alias(f"{name}_{side}") for side, r in (("low", rank), ("high", rank + 1))]
    out = ranked.groupBy(*keys).agg(F.first("n").alias("n"), *ends)
    return out.select(*keys, "n", *[_between(F.col(f"{name}_low"), F.col(f"{name}_high"), p).alias(name) for name, p in POINTS.items()])


def _sorted(x: DataFrame, keys: list[str], least: int) -> DataFrame:
    """By sorting each group as an array."""
    out = x.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("a")).withColumn("n", F.size("a").cast("long")).filter(F.col("n") >= least)
    at = lambda rank: F.get("a", rank.cast("int"))
    return out.select(*keys, "n", *[_between(at(rank), at(rank + 1), POINTS[name]).alias(name) for name, rank in _low().items()])


def quartiles_by(rows: DataFrame, keys: Sequence[str], value: str, least: int = 1, few: bool = False) -> DataFrame:
    """(keys, n, p25, median, p75) of the finite values of each group of at least `least`, with linear interpolation.

    few: the number of groups is bounded, and they may all be large.  Values are counted here and now, the rest is lazy.
    """
    keys = list(keys)
    x = rows.filter(F.abs(value) < float("inf")).select(*keys, F.col(value).alias("v"))
    if few:
        return _selected(x, keys, True).filter(F.col("n") >= least)
    large = _written(x.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select(*keys))
    if large.isEmpty():
        return _sorted(x, keys, least)
    some = F.broadcast(large)  # values / SMALL rows at most
    return _sorted(x.join(some, keys, "left_anti"), keys, least).unionByName(_selected(x.join(some, keys, "left_semi"), keys, False).filter(F.col("n") >= least))

"""Which files of a leaf have which tokens and values, so that a search reads only files that can have hits.

A leaf's token table has a row for each token and file, its range table one for each extra column and file: the least and greatest number, date and
text there.  Both are sorted by token or column, so a look-up reads the row groups of its own only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from . import snapshots

#: Dates and texts of ranges are cut to so many characters; cut ones keep their order.
RANGE_CHARS = 64
RANGES = "key string, file string, low double, high double, low_date string, high_date string, low_text string, high_text string"
#: A search whose tokens are in more files than these reads all leaves instead.
MOST_FILES = 10_000


def write(spark: SparkSession, where: str, leaf: str) -> None:
    """The token table of a leaf that is written already."""
    gold = spark.read.parquet(f"{where}/{snapshots.GOLD}/{leaf}")
    pairs = gold.select(F.col("_metadata.file_name").alias("file"), F.explode("tokens").alias("token")).distinct()
    pairs.orderBy("token", "file").write.mode("overwrite").parquet(f"{where}/{snapshots.TOKENS}/{leaf}")


def write_ranges(spark: SparkSession, where: str, leaf: str) -> None:
    """The range table of a leaf that is written already; columns are told by their normal headers."""
    gold = spark.read.parquet(f"{where}/{snapshots.GOLD}/{leaf}")
    pairs = gold.select(F.col("_metadata.file_name").alias("file"), F.explode("extra").alias("pair"))
    pairs = pairs.select("file", text.text_key(F.col("pair.header")).alias("key"), F.col("pair.value").alias("value")).filter(text.trimmed(text.blank(F.col("value"))) != "")
    start = lambda c: F.left(c, F.lit(RANGE_CHARS))
    of = {"": numbers.num_value(F.col("value")), "_date": start(dates.date_value(F.col("value"))), "_text": start(text.text_key(F.col("value")))}
    ranges = pairs.groupBy("key", "file").agg(*[f(c).alias(f"{name}{kind}") for kind, c in of.items() for name, f in (("low", F.min), ("high", F.max))])
    ranges.orderBy("key", "file").write.mode("overwrite").parquet(f"{where}/{snapshots.RANGES}/{leaf}")


def _beside(spark: SparkSession, where: str, folder: str, leaves: Sequence[str], schema: str | None = None) -> DataFrame:
    read = spark.read.option("basePath", f"{where}/{folder}")
    read = read.schema(f"{schema}, part int, schema_id int, g string") if schema else read
    return read.parquet(*[f"{where}/{folder}/{leaf}" for leaf in leaves])


def matching(spark: SparkSession, where: str, leaves: Sequence[str], terms: Sequence[tuple[str, bool]], ranges: Sequence[Column] = ()) -> DataFrame:
    """(leaf, file) of all files that have each of the terms, (token, prefix), and a row of their range table for each of the ranges."""
    tokens = [F.startswith("token", text.folded(F.lit(t))) if prefix else F.col("token") == text.folded(F.lit(t)) for t, prefix in terms]
    hits = []
    if tokens:
        table = _beside(spark, where, snapshots.TOKENS, leaves)
        hits += [table.filter(t) for t in tokens]
    if ranges:
        table = _beside(spark, where, snapshots.RANGES, leaves, RANGES)
        hits += [table.filter(r) for r in ranges]
    found = reduce(DataFrame.unionByName, [h.select("part", "schema_id", "g", "file", F.lit(i).alias("term")) for i, h in enumerate(hits)])
    leaf = F.format_string("part=%d/schema_id=%d/g=%s", F.col("part").cast("int"), F.col("schema_id").cast("int"), "g")
    return found.groupBy("part", "schema_id", "g", "file").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(hits)).select(leaf.alias("leaf"), "file")


def files(spark: SparkSession, where: str, leaves: Sequence[str], terms: Sequence[tuple[str, bool]], ranges: Sequence[Column] = ()) -> list[str] | None:
    """Paths of the files that a search for all terms and ranges has to read; None if there is no use in choosing, or a leaf is older than these tables."""
    if not (terms or ranges) or not leaves:
        return None
    try:
        found = matching(spark, where, leaves, terms, ranges).limit(MOST_FILES + 1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return files(spark, where, leaves, terms) if ranges else None
    return None if len(found) > MOST_FILES else [f"{where}/{snapshots.GOLD}/{r['leaf']}/{r['file']}" for r in found]

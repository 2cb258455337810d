"""Line deduplication over overlapping windows of three lines.

Lines are what `\\n` separates; those without a word are never counted nor removed.
Three consecutive counted lines make a window.  Of each window that is found more than
once, in the whole table, the first occurrence (by doc_id, then place) stays, and every
line covered by a later occurrence is removed.

Windows are hashed to 128 bits and counted with map-side combining; only repeated windows are
joined back, so a window that a third of all documents share costs a row per occurrence.

Defined cases: a null text counts as empty and stays null; rows alike in doc_id and text
are one document and are treated alike; a null doc_id sorts first; texts of under three
counted lines stay as they are; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WINDOW = 3
#: A line with a character outside \x20 and \x09-\x0D has a word.
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _counted(lines: Column) -> Column:
    """Places of the lines that have a word."""
    marks = F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(_WORD)), i))
    return F.array_compact(marks)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with `text` cleaned, and n_lines (counted ones) and n_removed as structs.

    Returns (doc: struct of all columns of docs, text, n_lines, n_removed).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    hashed = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), _lines(F.col(text)).alias("lines")).select(
        "id", "th", F.filter("lines", lambda x: F.regexp_like(x, F.lit(_WORD))).alias("lines")
    )
    hashed = hashed.filter(F.size("lines") >= WINDOW).select(
        "id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("h")
    )
    # Rows of one document are told apart by nothing, so one of them is enough.
    windows = hashed.select(
        "id", "th",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("h") - WINDOW),
                lambda i: F.struct(
                    F.xxhash64(*[F.get("h", i + k)["a"] for k in range(WINDOW)]).alias("a"),
                    F.xxhash64(*[F.get("h", i + k)["b"] for k in range(WINDOW)]).alias("b"),
                ),
            )
        ).alias("place", "w"),
    ).select("id", "th", F.col("place"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    windows = scratch.keep(windows, "windows")
    where = F.struct("id", "th", "place")
    repeated = windows.groupBy("a", "b").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first")
    later = windows.join(repeated.hint("merge"), ["a", "b"]).filter(~where.eqNullSafe(F.col("first"))).select("id", "th", "place")
    covered = scratch.keep(later.groupBy("id", "th").agg(F.collect_set("place").alias("starts")), "covered")
    scratch.drop("windows")
    # Merge joins at every size: Spark splits their hot partitions, and plans do not change as tables grow.
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias("id"), F.xxhash64(text).alias("th"))
    joined = rows.join(covered.select(F.col("id").alias("cid"), F.col("th").alias("cth"), "starts").hint("merge"), F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
    body = F.col(f"doc.{text}")
    # Only texts that lose lines are split for it; n_lines costs nothing where it isn't read.
    split = joined.select("doc", "starts", F.when(F.col("starts").isNotNull(), _lines(body)).alias("lines"))
    split = split.select("doc", "starts", "lines", _counted(F.col("lines")).alias("counted"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.slice("counted", s + 1, F.lit(WINDOW)))))
    marked = split.select("doc", "lines", gone.alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return marked.select(
        "doc",
        F.when(F.col("gone").isNull(), body).otherwise(cleaned).alias("text"),
        F.size(_counted(_lines(body))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )

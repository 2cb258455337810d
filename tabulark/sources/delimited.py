"""Delimited text files of unknown layout, read by Spark once their shape is known."""

from __future__ import annotations

import csv
import io
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trimmed
from .detection import HEADER_ROWS, MOST_COLUMNS, SAMPLE_ROWS
from .records import read_records

DELIMITERS = "\t;,|"
SNIFF_BYTES, SNIFF_RECORDS = 256 * 1024, 24


def head(spark: SparkSession, path: str) -> str:
    """The first bytes of a file in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(b & 0xFF for b in stream.readNBytes(SNIFF_BYTES)).decode("utf-8-sig", "replace")
    finally:
        stream.close()


def sniff(text: str, extension: str = "csv") -> str:
    """The delimiter whose records most often have the same width of over one."""
    best: tuple[int, int, str] | None = None
    for d in DELIMITERS:
        try:
            widths = [len(r) for r, _ in zip(csv.reader(io.StringIO(text), delimiter=d), range(SNIFF_RECORDS)) if len(r) > 1]
        except csv.Error:
            continue
        if widths:
            width, n = max(Counter(widths).items(), key=lambda x: (x[1], x[0]))
            if best is None or (n, width) > best[:2]:
                best = (n, width, d)
    return best[2] if best else "\t" if extension == "tsv" else ","


def first_rows(text: str, delimiter: str, n: int = HEADER_ROWS + SAMPLE_ROWS) -> list[list[str]]:
    """The first records that have a value; the others aren't numbered."""
    filled = (r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if any(c.strip() for c in r))
    return [r for r, _ in zip(filled, range(n))]


def read(spark: SparkSession, path: str, delimiter: str, least_width: int = 1) -> DataFrame:
    """All records that have a value as text columns c0, c1, ..., as wide as the widest, with their order in `line`.

    A first pass finds the greatest width, as columns may first appear far below, and whether
    a quoted cell has a line break; files with such cells are cut into records first.  Both ways read in splits.
    """
    raw = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    shape = raw.agg(F.max(_cells(F.col("value"), delimiter)).alias("widest"), F.count_if(quotes % 2 == 1).alias("broken")).first()
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false"}
    if shape["broken"]:
        found = read_records(spark, path, delimiter)
        widest = found.agg(F.max(_cells(F.col("record"), delimiter))).first()[0]
        schema = _schema(widest, least_width)
        records = found.select("line", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options | {"maxColumns": str(MOST_COLUMNS + 1)}).alias("r")).select("line", "r.*")
        return records.filter(trimmed(F.concat_ws("", *schema.names)) != "")
    schema = _schema(shape["widest"], least_width)
    records = spark.read.options(**options, multiLine="false", encoding="UTF-8").schema(schema).csv(path)
    return records.filter(trimmed(F.concat_ws("", *records.columns)) != "").select(F.monotonically_increasing_id().alias("line"), "*")


def _cells(record: Column, delimiter: str) -> Column:
    """How many cells a record has; delimiters in quoted cells don't count."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter))) + 1


def _schema(widest: int | None, least_width: int) -> T.StructType:
    width = max(widest or 1, least_width)
    if width > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])

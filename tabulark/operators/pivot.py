"""Pivots: the top rows and columns, the rest folded into "others", totals and an honest unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from .series import SUM_DIGITS

DIMENSIONS = {
    "recipient": "recipient_label", "sender": "sender_label", "company": "company_code_label", "product_code": "product_code_label", "trademark": "trademark_label",
    "origin_country": "origin_country_key", "dispatch_country": "dispatch_country_key", "trade_country": "trade_country_key", "month": "month", "year": "year",
}
METRICS = ("value", "rows", "net")
ROWS, COLUMNS, MOST = 20, 12, 100


def _metric(name: str) -> Column:
    return F.count("*").cast("double") if name == "rows" else F.coalesce(F.sum(name), F.lit(0.0))


def cells(rows: DataFrame, row: str, column: str, metric: str = "value") -> DataFrame:
    """(r, c, v) of all non-empty pairs."""
    label = lambda d: F.col(DIMENSIONS[d]).cast("string")
    x = rows.select(label(row).alias("r"), label(column).alias("c"), *([] if metric == "rows" else [metric]))
    return x.filter((F.col("r") != "") & (F.col("c") != "")).groupBy("r", "c").agg(_metric(metric).alias("v"))


def _top(grouped: DataFrame, key: str, limit: int, by_label: bool) -> DataFrame:
    """The first labels by total, or by label for time columns, found without sorting all in one task."""
    totals = grouped.groupBy(key).agg(F.sum("v").alias("t"))
    order = [F.col(key)] if by_label else [F.round("t", SUM_DIGITS).desc(), F.col(key)]
    few = totals.orderBy(*order).limit(limit)
    return few.select(F.col(key).alias(f"{key}_top"), F.row_number().over(Window.orderBy(*order)).alias(f"{key}_rank"))


def pivot(rows: DataFrame, row: str, column: str, metric: str = "value", n_rows: int = ROWS, n_columns: int = COLUMNS, others: str = "Others") -> DataFrame:
    """(row_label, column_label, row_rank, column_rank, v): cells, and totals where a label is null and its rank 0.

    Time columns keep the earliest labels; folded labels rank one past the limit.
    """
    n_rows, n_columns = max(1, min(n_rows, MOST)), max(1, min(n_columns, MOST))
    grouped = cells(rows, row, column, metric)
    x = grouped.join(F.broadcast(_top(grouped, "r", n_rows, False)), F.col("r") == F.col("r_top"), "left")  # at most MOST rows each
    x = x.join(F.broadcast(_top(grouped, "c", n_columns, column in ("month", "year"))), F.col("c") == F.col("c_top"), "left")
    folded = x.select(
        F.coalesce("r_top", F.lit(others)).alias("row_label"), F.coalesce("c_top", F.lit(others)).alias("column_label"),
        F.coalesce("r_rank", F.lit(n_rows + 1)).alias("row_rank"), F.coalesce("c_rank", F.lit(n_columns + 1)).alias("column_rank"), "v",
    )
    r, c = F.struct("row_rank", "row_label"), F.struct("column_rank", "column_label")
    cube = folded.select(r.alias("r"), c.alias("c"), "v").cube("r", "c").agg(F.sum("v").alias("v"))
    return cube.select(F.col("r.row_label").alias("row_label"), F.col("c.column_label").alias("column_label"), F.coalesce("r.row_rank", F.lit(0)).alias("row_rank"), F.coalesce("c.column_rank", F.lit(0)).alias("column_rank"), "v")


def wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """A cross table of a pivot's cells for known column labels."""
    return long.filter(F.col("row_label").isNotNull() & F.col("column_label").isNotNull()).groupBy("row_rank", "row_label").pivot("column_label", columns).agg(F.sum("v")).orderBy("row_rank")


def unit(rows: DataFrame, metric: str = "value") -> DataFrame:
    """The one unit all numbers of a pivot share, or null if it would mix several or unknown ones."""
    if metric == "rows":
        return rows.sparkSession.range(1).select(F.lit("rows").alias("unit"))
    key, empty = ("currency_key", "USD") if metric == "value" else ("unit_key", "kg")
    found = rows.filter(F.col(metric).isNotNull()).agg(F.count_distinct(key).alias("n"), F.min(key).alias("k"))
    return found.select(F.when(F.col("n") == 0, empty).when((F.col("n") == 1) & keys.is_known(F.col("k")), F.col("k")).alias("unit"))

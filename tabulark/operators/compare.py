"""Comparisons of two queries, ratios of overviews, and company dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import safe_ratio
from . import measures, prices, series

#: Sections of a dossier.
DOSSIER = ("product_codes", "trademarks", "product_groups", "origin_countries", "dispatch_countries", "trade_countries")
NAMES = 8


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """A row for each number of the overviews: both sides, their difference and its percentage.

    Money has a difference only where both sides are in the same single known currency.
    """
    def side(rows: DataFrame, name: str) -> DataFrame:
        whole = measures.overview(rows).crossJoin(measures.compatible(rows).select("compatible_currency"))  # one row each
        names = [c for c in whole.columns if c != "compatible_currency"]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])
        return whole.select(F.explode(pairs).alias("p"), F.col("compatible_currency").alias(f"{name}_currency")).select("p.metric", F.col("p.v").alias(name), f"{name}_currency")

    both = side(left, "left").join(side(right, "right"), "metric")
    money = F.col("metric").isin("total_value", "value_per_net")
    honest = ~money | F.coalesce(F.col("left_currency") == F.col("right_currency"), F.lit(False))
    delta = F.when(honest, F.col("right") - F.col("left"))
    return both.select("metric", "left", "right", delta.alias("delta"), F.when(F.abs("left") > 2.220446049250313e-16, delta / F.when(F.col("left") != 0, F.col("left")) * 100.0).alias("delta_percent"))


def story(rows: DataFrame) -> DataFrame:
    """Rows, value (single currency) and weight by declaration, and the largest country count."""
    o = measures.overview(rows).crossJoin(measures.compatible(rows).select("compatible_currency"))  # one row each
    per = lambda c: safe_ratio(F.col(c).cast("double"), F.col("declaration_count").cast("double"))
    return o.select(
        per("row_count").alias("rows_per_declaration"), F.when(F.col("compatible_currency").isNotNull(), per("total_value")).alias("value_per_declaration"), per("total_net").alias("net_per_declaration"),
        F.greatest("distinct_origin_countries", "distinct_dispatch_countries", "distinct_trade_countries").alias("most_countries"),
    )


def company_rows(gold: DataFrame, company: str) -> DataFrame:
    """Canonical rows of a company by its label."""
    return gold.filter(F.col("is_canonical") & (F.col("company_code_label") == text.label_value(F.lit(company))))


def company_names(rows: DataFrame, limit: int = NAMES) -> DataFrame:
    """How recipients of the company are spelled, most frequent first."""
    return rows.filter(F.col("recipient_label") != "").groupBy(F.col("recipient_label").alias("name")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "name").limit(limit)


def company_profile(gold: DataFrame, company: str, limit: int = 10) -> dict[str, DataFrame]:
    """All parts of a dossier over the same filtered rows."""
    rows = company_rows(gold, company)
    parts = {"overview": measures.overview(rows), "months": series.months(rows), "prices": prices.metrics(rows), "names": company_names(rows), "senders": series.section(rows, "senders", limit)}
    return parts | {kind: series.section(rows, kind, limit) for kind in DOSSIER}


def monthly_price(months: DataFrame) -> DataFrame:
    """Value over weight of each month, 0 without weight."""
    return months.select("month", safe_ratio(F.col("total_value"), F.col("total_net")).alias("average_price"))


def rows_per_month(months: DataFrame) -> Column:
    return F.sum("rows") / F.count("*")

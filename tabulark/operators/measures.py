"""Currency- and unit-safe measures: buckets that are never added across currencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.numbers import safe_ratio

DISTINCT = {
    "declaration_count": "declaration_number_label",
    "distinct_senders": "sender_label",
    "distinct_recipients": "recipient_label",
    "distinct_companies": "company_code_label",
    "distinct_trademarks": "trademark_label",
    "distinct_product_codes": "product_code_label",
    "distinct_origin_countries": "origin_country_key",
    "distinct_dispatch_countries": "dispatch_country_key",
    "distinct_trade_countries": "trade_country_key",
}


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0.0))


def paired(kg: bool = False) -> Column:
    """Rows with a value and a positive weight, in kilograms or as written."""
    return F.col("value").isNotNull() & (F.col("net_kg" if kg else "net") > 0)


def basis(rows: DataFrame) -> DataFrame:
    """One row of sums, without the distinct counts."""
    out = rows.agg(F.count("*").alias("row_count"), *[total(c).alias(f"total_{n}") for n, c in (("value", "value"), ("gross", "gross"), ("net", "net"), ("quantity", "quantity"))])
    return out.withColumn("value_per_net", safe_ratio(F.col("total_value"), F.col("total_net")))


def overview(rows: DataFrame) -> DataFrame:
    """One row of counts, distinct counts of non-empty labels, and sums."""
    distinct = [F.count_distinct(F.nullif(c, F.lit(""))).alias(n) for n, c in ((n, F.col(c)) for n, c in DISTINCT.items())]
    out = rows.agg(
        F.count("*").alias("row_count"), *distinct,
        *[total(c).alias(f"total_{n}") for n, c in (("value", "value"), ("gross", "gross"), ("net", "net"), ("quantity", "quantity"))],
        total("net_kg").alias("total_net_kg"), total("gross_kg").alias("total_gross_kg"),
    )
    return out.withColumn("value_per_net", safe_ratio(F.col("total_value"), F.col("total_net")))


def currency_totals(rows: DataFrame) -> DataFrame:
    """A row for each currency of valued rows: totals, and value and kilograms of rows with both."""
    both = paired(kg=True)
    return (
        rows.filter(F.col("value").isNotNull())
        .groupBy(F.col("currency_key").alias("currency"))
        .agg(
            F.count("*").alias("valued_rows"), total("value").alias("total_value"), F.count_if(both).alias("paired_rows"),
            F.coalesce(F.sum(F.when(both, F.col("value"))), F.lit(0.0)).alias("paired_value"),
            F.coalesce(F.sum(F.when(both, F.col("net_kg"))), F.lit(0.0)).alias("paired_kg"),
            F.array_join(F.array_sort(F.collect_set(F.when(both, F.col("unit_key")))), ",").alias("units"),
        )
        .withColumns({"known": keys.is_known(F.col("currency")), "value_per_kg": F.when(F.col("paired_kg") > 0, F.col("paired_value") / F.col("paired_kg"))})
    )


def weight_totals(rows: DataFrame, weight: str = "net") -> DataFrame:
    """A row for each weight unit: rows, total as written, its factor and total in kilograms (null if unknown)."""
    return (
        rows.filter(F.col(weight).isNotNull())
        .groupBy(F.col("unit_key").alias("unit"))
        .agg(F.count("*").alias("weighted_rows"), total(weight).alias("total_source"), F.sum(f"{weight}_kg").alias("total_kg"))
        .withColumn("factor", keys.unit_factor(F.col("unit")))
    )


def exclusions(rows: DataFrame) -> DataFrame:
    """Why rows don't count: one row of conditional counts."""
    cur, unit = ~keys.is_known(F.col("currency_key")), F.startswith("unit_key", F.lit(keys.UNKNOWN))
    value, net, gross = (F.col(c).isNotNull() for c in ("value", "net", "gross"))
    return rows.agg(
        F.count_if(value & cur).alias("value_without_currency"),
        F.count_if(net & unit).alias("net_without_unit"),
        F.count_if(gross & unit).alias("gross_without_unit"),
        F.count_if(value & net & cur).alias("ratio_without_currency"),
        F.count_if(value & net & unit).alias("ratio_without_unit"),
        F.count_if(value & ~F.coalesce(F.col("net") > 0, F.lit(False))).alias("ratio_without_weight"),
    )


def compatible(rows: DataFrame) -> DataFrame:
    """The one known currency and unit of all rows, or null where they are mixed or unknown."""
    found = rows.agg(
        F.collect_set(F.when(F.col("value").isNotNull(), F.col("currency_key"))).alias("c"),
        F.collect_set(F.when(F.col("net").isNotNull(), F.col("unit_key"))).alias("u"),
        F.collect_set(F.when(F.col("gross").isNotNull(), F.col("unit_key"))).alias("g"),
    )
    one = lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0)))
    return found.select(
        one("c").alias("single_currency"),
        F.when(keys.is_known(one("c")), one("c")).alias("compatible_currency"),
        one("u").alias("single_unit"),
        one("g").alias("single_gross_unit"),
        keys.unit_factor(one("u")).alias("unit_factor"),
    )


def subset_sums() -> list[Column]:
    """Sums of a month or group from which its measures are told; weights as written."""
    both = paired()
    return [
        F.count("value").alias("valued_rows"), F.count("net").alias("net_rows"), F.count("gross").alias("gross_rows"), F.count_if(both).alias("paired_rows"),
        F.coalesce(F.sum(F.when(both, F.col("value"))), F.lit(0.0)).alias("paired_value"),
        F.coalesce(F.sum(F.when(both, F.col("net"))), F.lit(0.0)).alias("paired_net"),
    ]


def by_currency(rows: DataFrame, label: Column) -> DataFrame:
    """(label, currencies: array of each currency's rows, value, paired rows, value and weight, largest first)."""
    both = paired()
    each = rows.filter(F.col("value").isNotNull()).groupBy(label.alias("label"), "currency_key").agg(
        F.count("*").alias("rows"), total("value").alias("value"), F.count_if(both).alias("paired_rows"),
        F.coalesce(F.sum(F.when(both, F.col("value"))), F.lit(0.0)).alias("paired_value"), F.coalesce(F.sum(F.when(both, F.col("net"))), F.lit(0.0)).alias("paired_net"),
    )
    split = F.sort_array(F.collect_list(F.struct("value", F.col("currency_key").alias("currency"), "rows", "paired_rows", "paired_value", "paired_net")), asc=False)
    return each.groupBy("label").agg(split.alias("currencies"))


def inherited(groups: DataFrame, query_rows: DataFrame) -> DataFrame:
    """Adds the measures that a group may honestly show.

    A group with its own split by currency keeps it; weights and ratios need one unit in
    the whole query, and ratios one with a factor.
    """
    out = groups.crossJoin(F.broadcast(compatible(query_rows)))  # one row
    kg = F.col("paired_net") * F.col("unit_factor")
    return out.withColumns({
        "value_known": (F.size("currencies") == 1) & keys.is_known(F.get(F.col("currencies"), F.lit(0))["currency"]),
        "net_kg_known": F.when(F.col("single_unit").isNotNull(), F.col("total_net") * F.col("unit_factor")),
        "value_per_kg": F.when((F.size("currencies") == 1) & (kg > 0), F.col("paired_value") / kg),
    })

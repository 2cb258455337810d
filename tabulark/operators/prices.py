"""Price statistics with exact quartiles (linear interpolation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.numbers import safe_ratio
from ..schema import PRICES
from .quantiles import POINTS, quartiles_by


def metrics(rows: DataFrame) -> DataFrame:
    """A row for each price kind: count, mean, extremes, weighted mean and quartiles.

    Weights are the net weight, but the quantity for prices by extra unit and the gross weight for
    prices by gross weight.
    """
    kinds = {"value_per_net": (F.when(F.col("net") > 0, F.col("value") / F.when(F.col("net") > 0, F.col("net"))), F.col("net"))}
    kinds |= {p: (F.col(p), F.col(w)) for p, w in PRICES.items()}
    one = []
    for kind, (price, weight) in kinds.items():
        use = price.isNotNull() & (weight > 0)
        one.append(
            F.struct(
                F.lit(kind).alias("kind"), F.count(price).alias("count"), F.coalesce(F.avg(price), F.lit(0.0)).alias("average"),
                F.coalesce(F.min(price), F.lit(0.0)).alias("minimum"), F.coalesce(F.max(price), F.lit(0.0)).alias("maximum"),
                F.coalesce(F.sum(F.when(use, price * weight)), F.lit(0.0)).alias("pw"), F.coalesce(F.sum(F.when(use, weight)), F.lit(0.0)).alias("w"),
            )
        )
    out = rows.agg(*[s.alias(f"m{i}") for i, s in enumerate(one)]).select(F.explode(F.array(*[f"m{i}" for i in range(len(one))])).alias("m")).select("m.*")
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), price.alias("price")) for kind, (price, _) in kinds.items()])).alias("x")).select("x.*")
    found = quartiles_by(each, ["kind"], "price", few=True)
    return out.join(F.broadcast(found), "kind", "left").select(  # a row a kind
        "kind", "count", "average", "minimum", "maximum", safe_ratio(F.col("pw"), F.col("w")).alias("weighted_average"), *[F.coalesce(q, F.lit(0.0)).alias(q) for q in POINTS]
    )


def cohorts(rows: DataFrame) -> DataFrame:
    """Value per kilogram for each known currency, never mixed."""
    priced = rows.filter(F.col("value").isNotNull() & (F.col("net_kg") > 0) & keys.is_known(F.col("currency_key")))
    priced = priced.select(F.col("currency_key").alias("currency"), "unit_key", "value", "net_kg", (F.col("value") / F.col("net_kg")).alias("price"))
    out = priced.groupBy("currency").agg(
        F.count("*").alias("samples"), F.avg("price").alias("average"), F.min("price").alias("minimum"), F.max("price").alias("maximum"),
        (F.sum("value") / F.sum("net_kg")).alias("weighted_average"), F.array_join(F.array_sort(F.collect_set("unit_key")), ",").alias("units"),
    )
    return out.join(quartiles_by(priced, ["currency"], "price", few=True), "currency", "left").select("currency", "samples", "average", "minimum", "maximum", "weighted_average", *POINTS, "units")


def box_bounds(stats: DataFrame) -> DataFrame:
    """Whiskers of 1.5 interquartile ranges inside the extremes, and whether anything lies beyond."""
    iqr = F.col("p75") - F.col("p25")
    return stats.withColumns({
        "iqr": iqr,
        "low": F.greatest("minimum", F.col("p25") - 1.5 * iqr),
        "high": F.least("maximum", F.col("p75") + 1.5 * iqr),
        "low_outliers": F.col("minimum") < F.col("p25") - 1.5 * iqr,
        "high_outliers": F.col("maximum") > F.col("p75") + 1.5 * iqr,
    })

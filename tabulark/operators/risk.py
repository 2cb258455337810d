"""Price-risk screen: prices far below the usual of comparable rows, with finer cohorts where they are large enough.

Cohorts are product, quarter, currency and unit, refined by brand and country.
Currency and unit are compared as written (upper case), so prices of different ones never meet.
The country is that of origin where any row has one, else the country, dispatch or trade country.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..storage import scratch_path
from .quantiles import quartiles_by

LEAST_SAMPLES, MOST_SAMPLES, FENCE = 20, 1000, 1.5
THRESHOLD, SAMPLES, LIMIT = 0.5, 20, 10
BASE = ["code_key", "period", "currency", "weight_unit"]
#: Finest first.
LEVELS = {"brand_country": ("brand_key", "country_key"), "brand": ("brand_key",), "country": ("country_key",), "base": ()}
COUNTRIES = ("origin_country_key", "country_key", "dispatch_country_key", "trade_country_key")
EXCLUSIONS = ("missing_product_code", "missing_period", "missing_currency", "missing_weight_unit", "invalid_value", "invalid_weight")
SORTS = ("deviation_percent", "price", "med", "robust_cutoff", "n", "date")


def parameters(threshold: float, samples: int) -> tuple[float, int]:
    threshold = min(max(threshold, 0.01), 1.0) if threshold == threshold and abs(threshold) != float("inf") else THRESHOLD
    return threshold, min(max(samples, LEAST_SAMPLES), MOST_SAMPLES)


def supported(rows: DataFrame) -> tuple[bool, str | None]:
    """Whether any row has a brand, and the first country column that any row has."""
    has = rows.agg(F.max(F.col("trademark_label") != "").alias("brand"), *[F.max(F.col(c) != "").alias(c) for c in COUNTRIES]).first()
    return bool(has["brand"]), next((c for c in COUNTRIES if has[c]), None)


def classified(rows: DataFrame, country: str | None) -> DataFrame:
    """Rows with their cohort keys, and the first rule that excludes them."""
    x = rows.select(
        "id", "date", "declaration_number", "recipient_label", "sender_label", "company_code_label", "description",
        text.text_key(F.col("product_code_label")).alias("code_key"), F.col("product_code_label").alias("code"), "value", F.col("net").alias("net_weight"),
        dates.quarter_key(F.col("month")).alias("period"), F.upper(text.blank(F.col("currency"))).alias("currency"), F.upper(text.blank(F.col("weight_unit"))).alias("weight_unit"),
        text.text_key(F.col("trademark_label")).alias("brand_key"), (text.blank(F.col(country)) if country else F.lit("")).alias("country_key"),
    )
    bad = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False))
    rules = zip(EXCLUSIONS, (F.col("code_key") == "", F.col("period") == "", F.col("currency") == "", F.col("weight_unit") == "", bad("value"), bad("net_weight")))
    out: Column | None = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return x.withColumn("exclusion", out).withColumn("price", F.when(F.col("exclusion").isNull(), F.try_divide("value", "net_weight")))


def statistics(priced: DataFrame, samples: int) -> DataFrame:
    """(level, cohort keys, n, p25, median, p75) of all cohorts of at least `samples` priced rows, at every level."""
    members = []
    for name, keys in LEVELS.items():
        filled = F.lit(True)
        for k in keys:
            filled = filled & (F.col(k) != "")
        members.append(F.when(filled, F.struct(F.lit(name).alias("level"), *[(F.col(k) if k in keys else F.lit("")).alias(k) for k in ("brand_key", "country_key")])))
    each = priced.select(*BASE, "price", F.explode(F.array_compact(F.array(*members))).alias("m")).select(*BASE, "price", "m.*")
    return quartiles_by(each, [*BASE, "level", "brand_key", "country_key"], "price", samples)


def resolved(x: DataFrame, samples: int) -> DataFrame:
    """(BASE, brand_key, country_key, s): for each set of all keys that rows have, the statistics of its finest large enough cohort.

    A finer cohort is no larger than its base, so only the prices of large enough bases go on.  The sets are far fewer than
    rows; levels are joined to them, and rows to the outcome only once.
    """
    spark, where = x.sparkSession, scratch_path(x.sparkSession, "cohorts")
    keyed = [*BASE, "brand_key", "country_key"]
    priced = x.filter("exclusion IS NULL").select(*keyed, "price")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    large = kept(priced.groupBy(*BASE).agg(F.count("*").alias("n")).filter(F.col("n") >= samples).select(*BASE), "large")
    if large.isEmpty():
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keyed) + ", s struct<level:string,n:long,p25:double,med:double,p75:double>")
    priced = kept(priced.join(large, BASE, "left_semi"), "priced")
    stats = kept(statistics(priced, samples), "statistics")
    out = priced.select(*keyed).distinct()
    for level, own in LEVELS.items():
        found = stats.filter(F.col("level") == level).select(*BASE, *own, F.struct(F.lit(level).alias("level"), "n", "p25", F.col("median").alias("med"), "p75").alias(f"s_{level}"))
        out = out.join(found, [*BASE, *own], "inner" if level == "base" else "left")
    return out.select(*keyed, F.coalesce(*[F.col(f"s_{level}") for level in LEVELS]).alias("s"))


def screened(rows: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES) -> DataFrame:
    """All rows with their exclusion or the statistics of their finest large enough cohort, and whether they are flagged."""
    threshold, samples = parameters(threshold, samples)
    brand, country = supported(rows)
    x = classified(rows, country)
    keyed = [*BASE, "brand_key", "country_key"]
    out = x.join(resolved(x, samples), keyed, "left").withColumn("s", F.when(F.col("exclusion").isNull(), F.col("s"))).select(*x.columns, "s.*")
    iqr = F.col("p75") - F.col("p25")
    out = out.withColumns({"iqr": iqr, "median_cutoff": F.col("med") * threshold, "lower_fence": F.greatest(F.col("p25") - FENCE * iqr, F.lit(0.0))})
    flagged = (F.col("med") > 0) & (F.col("p25") >= 0) & (F.col("iqr") >= 0) & (F.col("price") < F.col("median_cutoff")) & (F.col("price") < F.col("lower_fence"))
    few = lambda k, *levels: (F.col(k) != "") & ~F.col("level").isin(*levels)
    limitations = F.array_compact(F.array(
        F.lit("heuristic_not_proof"),
        F.when(F.col("n") < 30, "limited_sample"),
        F.when((F.col("med") > 0) & (F.col("iqr") / F.nullif(F.col("med"), F.lit(0.0)) > 0.5), "high_dispersion"),
        F.when(few("brand_key", "brand", "brand_country"), "brand_cohort_too_small") if brand else F.lit("brand_unavailable"),
        F.when(few("country_key", "country", "brand_country"), "country_cohort_too_small") if country else F.lit("country_unavailable"),
    ))
    return out.withColumns({
        "flagged": F.coalesce(flagged, F.lit(False)), "robust_cutoff": F.least("lower_fence", "median_cutoff"), "ratio": F.try_divide("price", "med"),
        "gap": F.greatest(F.col("med") * F.col("net_weight") - F.col("value"), F.lit(0.0)), "limitations": limitations,
    })


def _screen(rows: DataFrame, threshold: float, samples: int, screen: DataFrame | None) -> DataFrame:
    return screened(rows, threshold, samples) if screen is None else screen


def summary(rows: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES, screen: DataFrame | None = None) -> DataFrame:
    """One row of counts; money only where a single currency is flagged.

    screen: the result of `screened`, if there is one already.
    """
    x = _screen(rows, threshold, samples, screen)
    cohort = F.struct(*BASE, "level", *[F.when(F.col("level").isin(*[n for n, own in LEVELS.items() if k in own]), F.col(k)).alias(k) for k in ("brand_key", "country_key")])
    hit = lambda c: F.sum(F.when(F.col("flagged"), c)).alias
    # Rows are first summed by cohort, so that few are left to count different ones of.
    parts = x.groupBy("exclusion", F.when(F.col("level").isNotNull(), cohort).alias("cohort")).agg(
        F.count("*").alias("rows"), F.count_if("flagged").alias("hits"), hit(F.col("value"))("value"), hit(F.col("gap"))("gap")
    )
    code, seen, flagged = F.col("cohort.code_key"), F.col("cohort").isNotNull(), F.col("hits") > 0
    total = lambda rule, c="rows": F.coalesce(F.sum(F.when(rule, F.col(c))), F.lit(0))
    currencies = F.count_distinct(F.when(flagged, F.col("cohort.currency")))
    only = lambda c: F.when(currencies == 1, F.coalesce(F.sum(c), F.lit(0.0))).otherwise(0.0)
    eligible, evaluated = total(F.col("exclusion").isNull()), total(seen)
    return parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("query_rows"), *[total(F.col("exclusion") == n).alias(n) for n in EXCLUSIONS], eligible.alias("eligible_rows"), evaluated.alias("evaluated_rows"),
        F.count_distinct(code).alias("checked_codes"), F.count_distinct("cohort").alias("checked_cohorts"), total(flagged, "hits").alias("flagged_rows"),
        F.count_distinct(F.when(flagged, code)).alias("flagged_codes"), only("value").alias("flagged_value"), only("gap").alias("estimated_gap"), (eligible - evaluated).alias("insufficient_cohort"),
    )


def by_currency(rows: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES, screen: DataFrame | None = None) -> DataFrame:
    f = _screen(rows, threshold, samples, screen).filter("flagged")
    return f.groupBy("currency").agg(F.count("*").alias("flagged_rows"), F.sum("value").alias("flagged_value"), F.sum("gap").alias("estimated_gap"))


def by_company(rows: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES, limit: int = 8, screen: DataFrame | None = None) -> DataFrame:
    """Companies with the most flagged rows, and the gap in each currency."""
    f = _screen(rows, threshold, samples, screen).filter("flagged")
    each = f.groupBy(F.col("company_code_label").alias("company"), "currency").agg(F.count("*").alias("n"), F.sum("gap").alias("gap"))
    gaps = F.array_sort(F.collect_list(F.struct("currency", "gap")))
    return each.groupBy("company").agg(F.sum("n").alias("flagged_rows"), gaps.alias("gaps")).orderBy(F.col("flagged_rows").desc(), "company").limit(limit)


def _judged(flagged: DataFrame) -> DataFrame:
    spread = F.col("iqr") / F.col("med")
    confidence = F.when((F.col("n") >= 50) & (spread <= 0.5) & (F.col("level") != "base"), "high").when((F.col("n") >= 30) & (spread <= 0.75), "medium").otherwise("low")
    severity = F.when(F.col("ratio") < 0.25, "critical").when(F.col("ratio") < 0.4, "high").otherwise("moderate")
    return flagged.withColumns({"deviation_percent": F.greatest((1 - F.col("ratio")) * 100, F.lit(0.0)), "confidence": confidence, "severity": severity})


def rows_at_risk(rows: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES, limit: int | None = LIMIT, screen: DataFrame | None = None) -> DataFrame:
    """The lowest prices against their median first, with deviation, confidence and severity; all rows, in no order, without a limit."""
    out = _judged(_screen(rows, threshold, samples, screen).filter("flagged"))
    return out if limit is None else out.orderBy("ratio", F.col("gap").desc(), "id").limit(limit)


def by_confidence(rows: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES, screen: DataFrame | None = None) -> DataFrame:
    """How many flagged rows are of each confidence."""
    return rows_at_risk(rows, threshold, samples, None, screen).groupBy("confidence").agg(F.count("*").alias("flagged_rows"))


def table(at_risk: DataFrame, sort: str = "deviation_percent", descending: bool = True, confidence: str | None = None, currency: str | None = None, part: str = "") -> DataFrame:
    """Rows at risk of a confidence, a currency and a part of their texts, sorted by one of SORTS."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort: {sort}")
    out = at_risk if confidence is None else at_risk.filter(F.col("confidence") == confidence)
    out = out if currency is None else out.filter(F.col("currency") == currency.upper())
    if part.strip():
        searched = ("code", "description", "recipient_label", "sender_label", "company_code_label", "declaration_number")
        found = [text.contains_ci(F.col(c), part.strip()) for c in searched]
        hit = found[0]
        for f in found[1:]:
            hit = hit | f
        out = out.filter(hit)
    return out.orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), "id")

"""Aggregates made once for the scopes and years that most queries ask for, and the choice between them and the rows.

They are kept in parts that add up: each leaf of the gold table has its sums and the different labels, declarations and companies in them, by
whether rows are canonical and by year; an import makes those of its own leaf only.  Reading merges the parts, and expands them to scopes and years then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..plans.query import Query
from . import measures
from .quantiles import quartiles_by
from .series import section_label

KINDS = ("recipients", "senders", "companies", "trademarks", "product_groups", "origin_countries", "dispatch_countries", "trade_countries")
LEVELS = (2, 3, 4, 5, 6, 7, 8, 10)
SCOPES = ("canonical", "occurrences")
CELL = ("is_canonical", "year_key")
SCOPED = ("scope", "year_key")


def _celled(gold: DataFrame) -> DataFrame:
    return gold.withColumn("year_key", F.coalesce("year", F.lit(0)))


def _scoped(part: DataFrame) -> DataFrame:
    """Each row of a part for its scopes and for all years (0) and its own."""
    scopes = F.array_compact(F.array(F.lit("occurrences"), F.when(F.col("is_canonical"), "canonical")))
    years = F.array_distinct(F.array(F.lit(0), "year_key"))
    return part.withColumn("scope", F.explode(scopes)).withColumn("year_key", F.explode(years)).drop("is_canonical")


def _money() -> list[Column]:
    """What tells whether a sum of values is of one known currency."""
    v = F.when(F.col("value").isNotNull(), F.col("currency_key"))
    return [F.count("value").alias("valued_rows"), F.count_if(F.col("value").isNotNull() & ~keys.is_known(F.col("currency_key"))).alias("unknown_rows"), F.min(v).alias("least"), F.max(v).alias("most"), measures.total("value").alias("total_value")]


def _added(*names: str) -> list[Column]:
    """Sums of what parts have; extremes of `least` and `most`."""
    return [{"least": F.min, "most": F.max}.get(n, F.sum)(n).alias(n) for n in names]


def _usd() -> Column:
    """The total where every value is in US dollars; null where that isn't so; 0 without values."""
    return F.when(F.col("valued_rows") == 0, F.lit(0.0)).when((F.col("unknown_rows") == 0) & (F.col("least") == "USD") & (F.col("most") == "USD"), F.col("total_value")).alias("total_value_usd")


_SUBSET = ("net_rows", "gross_rows", "paired_rows", "paired_value", "paired_net")
_MONEY = ("valued_rows", "unknown_rows", "least", "most", "total_value")


def _subset() -> list[Column]:
    return measures.subset_sums()[1:]  # valued rows are in _money


# Parts, of any rows


def overview_sums(gold: DataFrame) -> DataFrame:
    t = measures.total
    return _celled(gold).groupBy(*CELL).agg(
        F.count("*").alias("row_count"), *_money(), t("gross_kg").alias("total_gross_kg"), t("net_kg").alias("total_net_kg"), t("quantity").alias("total_quantity"),
        F.count("net").alias("net_rows"), F.count_if(F.col("net").isNotNull() & F.col("net_kg").isNull()).alias("unknown_units"),
    )


def overview_labels(gold: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).alias("label")) for n, c in measures.DISTINCT.items()])
    return _celled(gold).select(*CELL, F.explode(each).alias("x")).select(*CELL, "x.*").filter("label <> ''").distinct()


def monthly_sums(gold: DataFrame) -> DataFrame:
    t, pair_kg = measures.total, measures.paired(kg=True)
    return _celled(gold.filter(F.col("month") != "")).groupBy(*CELL, "month").agg(
        F.count("*").alias("rows"), *_money(), t("net_kg").alias("total_net_kg"), F.coalesce(F.sum(F.when(pair_kg, F.col("value"))), F.lit(0.0)).alias("paired_kg_value"),
        F.coalesce(F.sum(F.when(pair_kg, F.col("net_kg"))), F.lit(0.0)).alias("paired_kg"), t("net").alias("total_net"), *_subset(),
    )


def monthly_labels(gold: DataFrame) -> DataFrame:
    return _celled(gold.filter((F.col("month") != "") & (F.col("declaration_number_label") != ""))).select(*CELL, "month", F.col("declaration_number_label").alias("label")).distinct()


def currency_sums(gold: DataFrame) -> DataFrame:
    return _celled(gold.filter(F.col("value").isNotNull())).groupBy(*CELL, F.col("currency_key").alias("currency")).agg(F.count("*").alias("valued_rows"), measures.total("value").alias("total_value"))


_SECTION = ("kind", "hs_level", "label")


def _labelled(gold: DataFrame, *columns: str) -> DataFrame:
    """A row for each label of a row, of all kinds and product levels."""
    label = lambda kind, level: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("hs_level"), section_label(kind, level).alias("label"))
    labels = F.array(*[label(k, 0) for k in KINDS], *[label("product_codes", n) for n in LEVELS])
    return _celled(gold).select(*CELL, *columns, F.explode(labels).alias("l")).select(*CELL, "l.*", *columns).filter("label <> ''")


def section_sums(gold: DataFrame) -> DataFrame:
    t = measures.total
    return _labelled(gold, "value", "net", "gross", "net_kg", "gross_kg", "quantity", "currency_key").groupBy(*CELL, *_SECTION).agg(
        F.count("*").alias("rows"), *_money(), t("net_kg").alias("total_net_kg"), t("gross_kg").alias("total_gross_kg"), t("quantity").alias("total_quantity"),
        t("net").alias("total_net"), t("gross").alias("total_gross"), *_subset(),
    )


def section_labels(gold: DataFrame) -> DataFrame:
    """The different declarations and companies of each label."""
    pairs = _labelled(gold, "declaration_number_label", "company_code_label").distinct()
    each = F.array(F.struct(F.lit("declarations").alias("what"), F.col("declaration_number_label").alias("value")), F.struct(F.lit("companies").alias("what"), F.col("company_code_label").alias("value")))
    return pairs.select(*CELL, *_SECTION, F.explode(each).alias("x")).select(*CELL, *_SECTION, "x.*").filter("value <> ''").distinct()


def prices(gold: DataFrame) -> DataFrame:
    """What price statistics are made of, one narrow row for each priced row; exact quartiles have no sums that add up."""
    priced = gold.filter(F.col("value").isNotNull() & (F.col("net_kg") > 0) & keys.is_known(F.col("currency_key")))
    return _celled(priced).select(*CELL, F.col("currency_key").alias("currency"), F.col("unit_key").alias("unit"), "value", "net_kg", "product_code_label", "trademark_label", "origin_country_key")


PARTS = {
    "overview_sums": overview_sums, "overview_labels": overview_labels, "monthly_sums": monthly_sums, "monthly_labels": monthly_labels, "currency_sums": currency_sums,
    "section_sums": section_sums, "section_labels": section_labels, "prices": prices,
}


# Merged parts


def _counted(labels: DataFrame, by: tuple[str, ...], names: dict[str, Column]) -> DataFrame:
    """How many different labels there are of each kind."""
    return _scoped(labels).distinct().groupBy(*by).agg(*[F.count_if(rule).alias(n) for n, rule in names.items()])


def _with_counts(sums: DataFrame, counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    names = [c for c in counts.columns if c not in by]
    return sums.join(counts, list(by), "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def merged_overview(parts: dict[str, DataFrame]) -> DataFrame:
    """A row for each scope and year; an empty table still has its scopes' rows for all years."""
    sums = _scoped(parts["overview_sums"]).groupBy(*SCOPED).agg(*_added("row_count", *_MONEY, "total_gross_kg", "total_net_kg", "total_quantity", "net_rows", "unknown_units"))
    both = _with_counts(sums, _counted(parts["overview_labels"], SCOPED, {n: F.col("what") == n for n in measures.DISTINCT}), SCOPED)
    monetary = (
        F.when(F.col("valued_rows") == 0, "empty").when(F.col("unknown_rows") > 0, "unavailable")
        .when((F.col("least") == "USD") & (F.col("most") == "USD"), "single_usd").otherwise("partitioned")
    )
    weight = F.when(F.col("net_rows") == 0, "empty").when(F.col("unknown_units") > 0, "unavailable").otherwise("normalized_kg")
    found = both.select(*SCOPED, "row_count", *measures.DISTINCT, _usd(), "total_gross_kg", "total_net_kg", "total_quantity", monetary.alias("monetary_mode"), weight.alias("weight_mode"))
    seed = found.sparkSession.createDataFrame([(s, 0) for s in SCOPES], "scope string, year_key int").join(found.select(*SCOPED), list(SCOPED), "left_anti")
    zero = {f.name: F.lit(0).cast(f.dataType) for f in found.schema.fields if f.name not in SCOPED}
    zero |= {"monetary_mode": F.lit("empty"), "weight_mode": F.lit("empty")}
    return found.unionByName(seed.withColumns(zero))


def merged_monthly(parts: dict[str, DataFrame]) -> DataFrame:
    by = (*SCOPED, "month")
    sums = _scoped(parts["monthly_sums"]).groupBy(*by).agg(*_added("rows", *_MONEY, "total_net_kg", "paired_kg_value", "paired_kg", "total_net", *_SUBSET))
    both = _with_counts(sums, _counted(parts["monthly_labels"], by, {"declarations": F.lit(True)}), by)
    return both.select(*by, "rows", "declarations", _usd(), "total_net_kg", "paired_kg_value", "paired_kg", "total_value", "total_net", "valued_rows", *_SUBSET)


def merged_currencies(parts: dict[str, DataFrame]) -> DataFrame:
    return _scoped(parts["currency_sums"]).groupBy(*SCOPED, "currency").agg(*_added("valued_rows", "total_value"))


def merged_sections(parts: dict[str, DataFrame]) -> DataFrame:
    by = (*SCOPED, *_SECTION)
    sums = _scoped(parts["section_sums"]).groupBy(*by).agg(*_added("rows", *_MONEY, "total_net_kg", "total_gross_kg", "total_quantity", "total_net", "total_gross", *_SUBSET))
    both = _with_counts(sums, _counted(parts["section_labels"], by, {n: F.col("what") == n for n in ("declarations", "companies")}), by)
    return both.select(*by, "rows", "declarations", "companies", _usd(), "total_net_kg", "total_gross_kg", "total_quantity", "total_value", "total_net", "total_gross", "valued_rows", *_SUBSET)


def merged_price_baselines(parts: dict[str, DataFrame]) -> DataFrame:
    """Value per kilogram of all, each product, brand and origin, by currency and unit."""
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("label"))
    kinds = F.array(kind("all", F.lit("")), kind("product_code", F.col("product_code_label")), kind("trademark", F.col("trademark_label")), kind("origin_country", F.col("origin_country_key")))
    x = _scoped(parts["prices"]).select(*SCOPED, "currency", "unit", "value", "net_kg", (F.col("value") / F.col("net_kg")).alias("price"), F.explode(kinds).alias("k"))
    x = x.select(*SCOPED, F.col("k.kind").alias("kind"), F.col("k.label").alias("label"), "currency", "unit", "value", "net_kg", "price").filter("kind = 'all' OR label <> ''")
    group = [*SCOPED, "kind", "label", "currency", "unit"]
    out = x.groupBy(*group).agg(
        F.count("*").alias("samples"), F.avg("price").alias("average"), F.min("price").alias("minimum"), F.max("price").alias("maximum"), (F.sum("value") / F.sum("net_kg")).alias("weighted_average"),
    )
    return out.join(quartiles_by(x, group, "price").drop("n"), group, "left")


MERGED = {"overview": merged_overview, "monthly": merged_monthly, "currencies": merged_currencies, "sections": merged_sections, "price_baselines": merged_price_baselines}
NEEDED = {
    "overview": ("overview_sums", "overview_labels"), "monthly": ("monthly_sums", "monthly_labels"), "currencies": ("currency_sums",), "sections": ("section_sums", "section_labels"),
    "price_baselines": ("prices",),
}


def rolled(gold: DataFrame, name: str) -> DataFrame:
    """A rollup of rows that have no stored parts."""
    return MERGED[name]({p: PARTS[p](gold) for p in NEEDED[name]})


def overview(gold: DataFrame) -> DataFrame:
    return rolled(gold, "overview")


def monthly(gold: DataFrame) -> DataFrame:
    return rolled(gold, "monthly")


def currencies(gold: DataFrame) -> DataFrame:
    return rolled(gold, "currencies")


def sections(gold: DataFrame) -> DataFrame:
    return rolled(gold, "sections")


def price_baselines(gold: DataFrame) -> DataFrame:
    return rolled(gold, "price_baselines")


def write_parts(gold: DataFrame, where: str, leaf: str) -> None:
    """All parts of a leaf's rows, in folders of its name."""
    for name, make in PARTS.items():
        make(gold).write.mode("overwrite").parquet(f"{where}/{name}/{leaf}")


def validate(gold: DataFrame, rolled: DataFrame) -> None:
    have = {r["scope"]: r["row_count"] for r in rolled.filter("year_key = 0").select("scope", "row_count").collect()}  # a row a scope
    want = gold.agg(F.count("*").alias("occurrences"), F.count_if("is_canonical").alias("canonical")).first().asDict()
    if have != want:
        raise ValueError(f"rollups count {have}, rows {want}")


def eligible(q: Query) -> bool:
    """A query that only asks for a scope and perhaps a year."""
    return not q.text.strip() and q.advanced is None and q.snapshot is None and not any(v.strip() for k, v in q.filters.items() if k != "year")


def chosen(overview: DataFrame, q: Query) -> DataFrame:
    """The overview row that answers an eligible query, if there is one."""
    return overview.filter((F.col("scope") == q.scope) & (F.col("year_key") == int(q.filters.get("year") or 0)))


def is_safe(row: DataFrame) -> bool:
    """Whether currencies and units are all known, so that sums are what rows would give."""
    mode = row.select("monetary_mode", "weight_mode").first()
    return mode is not None and mode["monetary_mode"] != "unavailable" and mode["weight_mode"] != "unavailable"

"""Queries over the trade table of the generated data, each with the same question in SQL."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape as xml_escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import dates, numbers, registry, text
from .operators import compare, export, measures, pivot, prices, risk, rollups, search, series
from .plans import compiler
from .plans.query import Condition, Group, Query
from .sources import gold as gold_tables
from .sources import ingest, snapshots
from .storage import scratch_path, write_bytes
from .testdata import FACTS_SQL, derived_facts

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}

CANONICAL = "SELECT * FROM facts WHERE is_canonical"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _rounded(df: DataFrame, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, as sums depend on their order in the last digits; a nudge lets ties go up in every engine."""
    return df.select(*[F.round(F.col(quoted(c)) + nudge, digits).alias(c) if t == "double" else F.col(quoted(c)) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 4, kilograms: bool = False):
    """Registers a query over gold rows; sql continues a WITH list that has `facts`, `f` (canonical rows).

    kilograms: converted weights make large sums with many digits and ties, so both sides
    round to two digits after a nudge.
    """

    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        form = (2, 1e-5) if kilograms else (digits, 0.0)
        QUERIES[name] = lambda spark, sf_dir: _rounded(fn(derived_facts(spark, sf_dir)), *form)
        if sql is not None:
            SQL[name] = f"{FACTS_SQL}, f AS ({CANONICAL})\n" + (re.sub(r"(?<!1), 4\)", " + 1e-5, 2)", sql) if kilograms else sql)
        return fn

    return add


def _canonical(g: DataFrame) -> DataFrame:
    return compiler.apply(g, Query())


# Overviews and measures

_OVERVIEW = """
  count(*) AS row_count, count(DISTINCT nullif(declaration, '')) AS declaration_count, count(DISTINCT nullif(sender, '')) AS distinct_senders,
  count(DISTINCT nullif(recipient, '')) AS distinct_recipients, count(DISTINCT nullif(company, '')) AS distinct_companies,
  count(DISTINCT nullif(trademark, '')) AS distinct_trademarks, count(DISTINCT nullif(product, '')) AS distinct_product_codes,
  count(DISTINCT nullif(origin_key, '')) AS distinct_origin_countries, count(DISTINCT nullif(dispatch_key, '')) AS distinct_dispatch_countries,
  count(DISTINCT nullif(trade_key, '')) AS distinct_trade_countries,
  round(coalesce(sum(value), 0), 4) AS total_value, round(coalesce(sum(gross), 0), 4) AS total_gross, round(coalesce(sum(net), 0), 4) AS total_net, round(coalesce(sum(quantity), 0), 4) AS total_quantity
"""
query("overview", f"SELECT {_OVERVIEW}, round(coalesce(sum(net_kg), 0), 4) AS total_net_kg, round(coalesce(sum(gross_kg), 0), 4) AS total_gross_kg, round(sum(value) / sum(net), 4) AS value_per_net FROM f")(lambda g: measures.overview(_canonical(g)))
query("overview_occurrences", f"SELECT {_OVERVIEW}, round(coalesce(sum(net_kg), 0), 4) AS total_net_kg, round(coalesce(sum(gross_kg), 0), 4) AS total_gross_kg, round(sum(value) / sum(net), 4) AS value_per_net FROM facts")(
    lambda g: measures.overview(compiler.apply(g, Query(scope="occurrences")))
)
query("overview_basis", "SELECT count(*) AS row_count, round(sum(value), 4) AS total_value, round(sum(gross), 4) AS total_gross, round(sum(net), 4) AS total_net, round(sum(quantity), 4) AS total_quantity, round(sum(value) / sum(net), 4) AS value_per_net FROM f WHERE year = 1997")(
    lambda g: measures.basis(compiler.apply(g, Query(filters={"year": "1997"})))
)
_PAIR = "value IS NOT NULL AND net_kg > 0"
query("currency_totals", f"""
SELECT currency_key AS currency, count(*) AS valued_rows, round(sum(value), 4) AS total_value, count(*) FILTER (WHERE {_PAIR}) AS paired_rows,
  round(coalesce(sum(value) FILTER (WHERE {_PAIR}), 0), 4) AS paired_value, round(coalesce(sum(net_kg) FILTER (WHERE {_PAIR}), 0), 4) AS paired_kg,
  coalesce(string_agg(DISTINCT unit_key, ',' ORDER BY unit_key) FILTER (WHERE {_PAIR}), '') AS units, NOT starts_with(currency_key, '__unknown__') AS known,
  round(sum(value) FILTER (WHERE {_PAIR}) / nullif(sum(net_kg) FILTER (WHERE {_PAIR}), 0), 4) AS value_per_kg
FROM f WHERE value IS NOT NULL GROUP BY currency_key""")(lambda g: measures.currency_totals(_canonical(g)))
for _weight in ("net", "gross"):
    query(f"weight_totals_{_weight}", f"""
SELECT unit_key AS unit, count(*) AS weighted_rows, round(sum({_weight}), 4) AS total_source, round(sum({_weight}_kg), 4) AS total_kg, round(max(factor), 4) AS factor
FROM f WHERE {_weight} IS NOT NULL GROUP BY unit_key""")(lambda g, w=_weight: measures.weight_totals(_canonical(g), w))
query("measure_exclusions", """
SELECT count(*) FILTER (WHERE value IS NOT NULL AND starts_with(currency_key, '__unknown__')) AS value_without_currency,
  count(*) FILTER (WHERE net IS NOT NULL AND starts_with(unit_key, '__unknown__')) AS net_without_unit,
  count(*) FILTER (WHERE gross IS NOT NULL AND starts_with(unit_key, '__unknown__')) AS gross_without_unit,
  count(*) FILTER (WHERE value IS NOT NULL AND net IS NOT NULL AND starts_with(currency_key, '__unknown__')) AS ratio_without_currency,
  count(*) FILTER (WHERE value IS NOT NULL AND net IS NOT NULL AND starts_with(unit_key, '__unknown__')) AS ratio_without_unit,
  count(*) FILTER (WHERE value IS NOT NULL AND (net IS NULL OR net <= 0)) AS ratio_without_weight
FROM f""")(lambda g: measures.exclusions(_canonical(g)))
query("compatible_measures", """
SELECT CASE WHEN count(DISTINCT currency_key) = 1 THEN min(currency_key) END AS single_currency,
  CASE WHEN count(DISTINCT currency_key) = 1 AND NOT starts_with(min(currency_key), '__unknown__') THEN min(currency_key) END AS compatible_currency,
  CASE WHEN count(DISTINCT unit_key) FILTER (WHERE net IS NOT NULL) = 1 THEN min(unit_key) END AS single_unit,
  CASE WHEN count(DISTINCT unit_key) FILTER (WHERE gross IS NOT NULL) = 1 THEN min(unit_key) END AS single_gross_unit,
  CASE WHEN count(DISTINCT unit_key) FILTER (WHERE net IS NOT NULL) = 1 THEN round(min(factor), 4) END AS unit_factor
FROM f WHERE dispatch_key = 'AFRICA'""")(lambda g: measures.compatible(compiler.apply(g, Query(filters={"dispatch_country": "Africa"}))))

# Series and rankings

_SUBSET = """count(value) AS valued_rows, count(net) AS net_rows, count(gross) AS gross_rows, count(*) FILTER (WHERE value IS NOT NULL AND net > 0) AS paired_rows,
  round(coalesce(sum(value) FILTER (WHERE net > 0), 0), 4) AS paired_value, round(coalesce(sum(net) FILTER (WHERE value IS NOT NULL AND net > 0), 0), 4) AS paired_net"""
_MONTHS = f"""SELECT month, count(*) AS rows, count(DISTINCT nullif(declaration, '')) AS declarations, round(coalesce(sum(value), 0), 4) AS total_value, round(coalesce(sum(net), 0), 4) AS total_net, {_SUBSET}
FROM f WHERE month <> '' GROUP BY month"""
query("months", _MONTHS)(lambda g: series.months(_canonical(g)))
query("months_newest", f"{_MONTHS} ORDER BY month DESC LIMIT 24")(lambda g: series.months(_canonical(g), 24))
_LABEL_SQL = {
    "recipients": "recipient", "senders": "sender", "companies": "company", "product_codes": "substr(product, 1, 4)", "trademarks": "trademark", "product_groups": "substr(description, 1, 80)",
    "origin_countries": "origin_key", "dispatch_countries": "dispatch_key", "trade_countries": "trade_key",
}


def _section_sql(label: str, rows: str = "f", limit: int = 10) -> str:
    return f"""
, whole AS (SELECT count(*) AS n, sum(value) AS v, sum(net) AS w, count(DISTINCT currency_key) FILTER (WHERE value IS NOT NULL) = 1 AS one FROM {rows}), g AS (
  SELECT {label} AS label, count(*) AS rows, count(DISTINCT nullif(declaration, '')) AS declarations, count(DISTINCT nullif(company, '')) AS companies,
    coalesce(sum(value), 0) AS tv, coalesce(sum(net), 0) AS tn, coalesce(sum(gross), 0) AS tg, coalesce(sum(quantity), 0) AS tq, {_SUBSET}
  FROM {rows} WHERE {label} <> '' GROUP BY 1 ORDER BY round(tv, 4) DESC, round(tn, 4) DESC, rows DESC, lower(label), label LIMIT {limit})
SELECT label, rows, declarations, companies, round(tv, 4) AS total_value, round(tn, 4) AS total_net, round(tg, 4) AS total_gross, round(tq, 4) AS total_quantity,
  valued_rows, net_rows, gross_rows, paired_rows, paired_value, paired_net,
  round(CASE WHEN one AND v > 0 THEN tv * 100 / v WHEN w > 0 THEN tn * 100 / w ELSE rows * 100.0 / n END, 4) AS share_percent, round(CASE WHEN tn = 0 THEN 0 ELSE tv / tn END, 4) AS value_per_net
FROM g, whole"""


for _kind, _label in _LABEL_SQL.items():
    query(f"section_{_kind}", _section_sql(_label))(lambda g, k=_kind: series.section(_canonical(g), k))
for _level in (2, 6, 8, 10):
    query(f"section_product_codes_{_level}", _section_sql(f"substr(product, 1, {_level})"))(lambda g, n=_level: series.section(_canonical(g), "product_codes", hs_level=n))
for _by, _order in (("label", "lower(label)"), ("companies", "companies"), ("share", "share_percent"), ("value_per_kg", "value_per_net")):
    query(f"section_sorted_by_{_by}", f"{_section_sql('recipient')} ORDER BY {_order}, lower(label), label LIMIT 4")(lambda g, b=_by: series.sorted_groups(series.section(_canonical(g), "recipients"), b, False).limit(4))
query("section_single_currency", ", u AS (SELECT * FROM f WHERE dispatch_key = 'AFRICA')" + _section_sql("sender", "u", 20))(
    lambda g: series.section(compiler.apply(g, Query(filters={"dispatch_country": "AFRICA"})), "senders", 20)
)
query("top_senders_of_year", ", u AS (SELECT * FROM f WHERE year = 1997)" + _section_sql("sender", "u"))(lambda g: series.section(compiler.apply(g, Query(filters={"year": "1997"})), "senders"))
query("currency_split", """
, e AS (SELECT dispatch_key AS label, currency_key, count(*) AS n, round(sum(value), 2) AS v FROM f WHERE value IS NOT NULL GROUP BY ALL)
SELECT label, string_agg(currency_key || ':' || n || ':' || CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR), ';' ORDER BY v DESC) AS split FROM e GROUP BY label""")(
    lambda g: measures.by_currency(_canonical(g), F.col("dispatch_country_key")).select(
        "label", F.array_join(F.transform("currencies", lambda c: F.concat_ws(":", c["currency"], c["rows"].cast("string"), c["value"].cast("decimal(18,2)").cast("string"))), ";").alias("split")
    )
)
query("inherited_measures", """
, e AS (SELECT * FROM f WHERE unit_key = 'lb'), g AS (SELECT month, round(sum(net), 4) AS tn, count(DISTINCT currency_key) AS k, min(currency_key) AS c,
   sum(value) FILTER (WHERE net > 0) AS pv, sum(net) FILTER (WHERE net > 0) AS pn FROM e GROUP BY month)
SELECT month, k = 1 AND NOT starts_with(c, '__unknown__') AS value_known, round(tn * 0.45359237, 4) AS net_kg_known,
  CASE WHEN k = 1 AND pn > 0 THEN round(pv / (pn * 0.45359237), 4) END AS value_per_kg FROM g""")(
    lambda g: _inherited_months(compiler.apply(g, Query(advanced=Condition("weight_unit", "any_of", ["lb"]))))
)


def _inherited_months(rows: DataFrame) -> DataFrame:
    split = measures.by_currency(rows, F.col("month")).withColumnRenamed("label", "month")
    return measures.inherited(series.months(rows).join(split, "month"), rows).select("month", "value_known", "net_kg_known", "value_per_kg")


query("month_trend", f"""
, m AS ({_MONTHS}), x AS (SELECT m.month, m.rows, m.total_value AS p, y.total_value AS ago FROM m LEFT JOIN m y ON m.month = CAST(CAST(substr(y.month, 1, 4) AS INT) + 1 AS VARCHAR) || substr(y.month, 5, 3))
SELECT month, rows, p AS primary, ago AS year_ago, round((p - lag(p) OVER w) / nullif(lag(p) OVER w, 0) * 100, 4) AS month_change, round((p - ago) / nullif(ago, 0) * 100, 4) AS year_change,
  round(sum(p) OVER (ORDER BY month), 4) AS cumulative, p = max(p) OVER () AS is_peak, round(avg(p) OVER (), 4) AS average,
  round((last_value(p) OVER r - first_value(p) OVER r) / first_value(p) OVER r * 100, 4) AS since_first
FROM x WINDOW w AS (ORDER BY month), r AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")(lambda g: series.trend(_rounded(series.months(_canonical(g)))))
query("month_trend_last_12", f"""
, m AS ({_MONTHS} ORDER BY month DESC LIMIT 12) SELECT month, round(total_net, 4) AS primary, round(sum(total_net) OVER (ORDER BY month), 4) AS cumulative FROM m""")(
    lambda g: series.trend(series.months(_canonical(g)), "total_net", last=12).select("month", "primary", "cumulative")
)
query("pareto", f"""
{_section_sql("trademark", limit=25).replace("SELECT label, rows,", ", s AS (SELECT label, rows,", 1)})
SELECT label, rows, row_number() OVER (ORDER BY total_value DESC, total_net DESC, rows DESC, lower(label)) AS rank,
  round(sum(rows) OVER (ORDER BY total_value DESC, total_net DESC, rows DESC, lower(label) ROWS UNBOUNDED PRECEDING) * 100.0 / sum(rows) OVER (), 4) AS cumulative_percent FROM s""")(
    lambda g: series.pareto(series.section(_canonical(g), "trademarks", 25)).select("label", "rows", F.col("rank").cast("long").alias("rank"), "cumulative_percent")
)
query("monthly_price", f"SELECT month, round(CASE WHEN total_net = 0 THEN 0 ELSE total_value / total_net END, 4) AS average_price FROM ({_MONTHS})")(lambda g: compare.monthly_price(series.months(_canonical(g))))
query("rows_per_month", f"SELECT round(sum(rows) / count(*), 4) AS rows_per_month FROM ({_MONTHS})")(lambda g: series.months(_canonical(g)).agg(compare.rows_per_month(None).alias("rows_per_month")))

# Prices

_STAT = "count(p) AS count, coalesce(avg(p), 0) AS average, coalesce(min(p), 0) AS minimum, coalesce(max(p), 0) AS maximum, coalesce(sum(p * w) FILTER (WHERE w > 0) / nullif(sum(w) FILTER (WHERE p IS NOT NULL AND w > 0), 0), 0) AS weighted_average, coalesce(quantile_cont(p, 0.25), 0) AS p25, coalesce(quantile_cont(p, 0.5), 0) AS median, coalesce(quantile_cont(p, 0.75), 0) AS p75"
_KINDS = {"value_per_net": ("CASE WHEN net > 0 THEN value / net END", "net"), "rfv": ("rfv", "net"), "rmv_net": ("rmv_net", "net"), "rmv_extra": ("rmv_extra", "quantity"), "rmv_gross": ("rmv_gross", "gross"), "min_base": ("min_base", "net")}
_METRICS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {_STAT} FROM (SELECT {p} AS p, {w} AS w FROM f)" for k, (p, w) in _KINDS.items())
_STATS = ("average", "minimum", "maximum", "weighted_average", "p25", "median", "p75")
query("price_metrics", f"SELECT kind, count, {', '.join(f'round({c}, 4) AS {c}' for c in _STATS)} FROM ({_METRICS})")(lambda g: prices.metrics(_canonical(g)))
query("price_box_bounds", f"""
SELECT kind, round(p75 - p25, 4) AS iqr, round(greatest(minimum, p25 - 1.5 * (p75 - p25)), 4) AS low, round(least(maximum, p75 + 1.5 * (p75 - p25)), 4) AS high,
  minimum < p25 - 1.5 * (p75 - p25) AS low_outliers, maximum > p75 + 1.5 * (p75 - p25) AS high_outliers FROM ({_METRICS})""")(
    lambda g: prices.box_bounds(prices.metrics(_canonical(g))).select("kind", "iqr", "low", "high", "low_outliers", "high_outliers")
)
query("price_cohorts", """
SELECT currency_key AS currency, count(*) AS samples, round(avg(p), 4) AS average, round(min(p), 4) AS minimum, round(max(p), 4) AS maximum, round(sum(value) / sum(net_kg), 4) AS weighted_average,
  round(quantile_cont(p, 0.25), 4) AS p25, round(quantile_cont(p, 0.5), 4) AS median, round(quantile_cont(p, 0.75), 4) AS p75, string_agg(DISTINCT unit_key, ',' ORDER BY unit_key) AS units
FROM (SELECT *, value / net_kg AS p FROM f WHERE value IS NOT NULL AND net_kg > 0 AND NOT starts_with(currency_key, '__unknown__')) GROUP BY currency_key""")(lambda g: prices.cohorts(_canonical(g)))

# Search: each predicate by the count and the sum of ids of its rows


def _hits(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("id"), F.lit(0)).cast("double").alias("ids"))


def predicate(name: str, q: Query, where: str, rows: str = "f", substring: bool = False) -> None:
    query(f"where_{name}", f"SELECT count(*) AS rows, coalesce(sum(id), 0)::DOUBLE AS ids FROM {rows} WHERE {where}")(lambda g: _hits(compiler.apply(g, q, substring)))


def _one(field: str, op: str, value=None, negated: bool = False) -> Query:
    return Query(advanced=Condition(field, op, value, negated))


predicate("occurrences", Query(scope="occurrences"), "true", "facts")
predicate("snapshot", Query(snapshot=50_000_000), "id <= 50000000")
predicate("text_token", Query("widget"), "list_contains(string_split(description, ' '), 'widget')")
predicate("text_tokens_and", Query("Red WIDGET"), "description = 'red widget'")
predicate("text_prefix", Query("wid*"), "description LIKE 'wid%' OR description LIKE '% wid%'")
predicate("text_number_prefix", Query("customer 00000001"), "recipient LIKE 'Customer#00000001%' OR sender LIKE 'Supplier#00000001%' OR company = '00000001'")
predicate("text_substring", Query("idget"), "description LIKE '%idget%'", substring=True)
predicate("code_shortcut", Query("89000019"), "product LIKE '89000019%' OR company = '89000019'")
predicate("company_by_text", Query("00000769"), "company = '00000769' OR false")
predicate("year", Query(filters={"year": "1997"}), "year = 1997")
predicate("product_prefix", Query(filters={"product_code": "89"}), "product LIKE '89%'")
predicate("company_code", Query(filters={"company_code": " 00000769 "}), "company = '00000769'")
predicate("trademark", Query(filters={"trademark": "brand#21"}), "trademark = 'Brand#21'")
predicate("description_contains", Query(filters={"description": "RED wid"}), "description LIKE 'red wid%'")
predicate("sender_contains", Query(filters={"sender": "supplier#00000000"}), "sender LIKE 'Supplier#00000000%'")
predicate("recipient_contains", Query(filters={"recipient": "Customer#0000007"}), "recipient LIKE 'Customer#0000007%'")
predicate("origin_country", Query(filters={"origin_country": "Китай"}), "origin_key = 'CN'")
predicate("dispatch_country", Query(filters={"dispatch_country": "middle east"}), "dispatch_key = 'MIDDLEEAST'")
predicate("trade_country_placeholder", Query(filters={"trade_country": "NA"}), "trade_key = ''")
predicate("contains", _one("description", "contains", "BOLT"), "description LIKE '%bolt%'")
predicate("contains_negated", _one("description", "contains", "bolt", True), "NOT description LIKE '%bolt%'")
predicate("equals_text", _one("description", "equals", " Red  Widget "), "description = 'red widget'")
predicate("equals_code", _one("company_code", "equals", "00000769"), "company = '00000769'")
predicate("equals_country", _one("origin_country", "equals", "germany"), "origin_key = 'DE'")
predicate("equals_number", _one("quantity", "equals", "20"), "quantity = 20")
predicate("equals_year", _one("year", "equals", "1998"), "year = 1998")
predicate("equals_date", _one("date", "equals", "1997-05-28"), "date = '1997-05-28'")
predicate("starts_with_code", _one("product_code", "starts_with", "12"), "product LIKE '12%'")
predicate("starts_with_text", _one("description", "starts_with", "Blue "), "description LIKE 'blue%'")
predicate("any_of", _one("trademark", "any_of", ["Brand#1", "", "brand#2"]), "trademark IN ('Brand#1', 'Brand#2')")
predicate("range_number", _one("value", "range", ["1 000,00", "2,500.5"]), "value BETWEEN 1000 AND 2500.5")
predicate("range_grouped_style", _one("value", "range", ["1.250", ""]), "value >= 1250")
predicate("range_decimal_style", _one("net_weight", "range", ["", "12.500"]), "net <= 12.5")
predicate("range_date_as_text", _one("date", "range", ["1998-01-10", "1998-01-2"]), "date BETWEEN '1998-01-10' AND '1998-01-2'")
predicate("range_year", _one("year", "range", ["1996", "1997"]), "year BETWEEN 1996 AND 1997")
predicate("empty", _one("weight_unit", "empty"), "unit_key = '__unknown__'")
predicate("not_empty", _one("currency", "not_empty"), "currency_key <> '__unknown__'")
predicate("extra_equals", _one("extra:return FLAG", "equals", "r"), "flag = 'R'")
predicate("extra_starts_with", _one("extra:Ship date", "starts_with", "1998-0"), "ship LIKE '1998-0%'")
predicate("extra_range_date", _one("extra:Ship date", "range", ["10.01.1998", "1998-02-05"]), "ship BETWEEN '1998-01-10' AND '1998-02-05'")
predicate("extra_date_any_of", _one("schema:1:extra:ship DATE", "any_of", ["14.03.1997", "", "1996-7-2"]), "ship IN ('1997-03-14', '1996-07-02')")
predicate("source_file", Query(scope="occurrences", advanced=Condition("source_file", "equals", "B.CSV")), "source_file = 'b.csv'", "facts")
predicate("source_guard", _one("schema:2:description", "contains", "bolt", True), "true")
predicate("nested", Query(advanced=Group("and", [
    Group("or", [Condition("description", "contains", "bolt"), Condition("description", "contains", "gear")]),
    Condition("year", "range", ["1996", "1998"]),
    Group("or", [Condition("origin_country", "equals", "CN"), Condition("quantity", "range", ["40", None])], negated=True),
    Group("and", []),
])), "(description LIKE '%bolt%' OR description LIKE '%gear%') AND year BETWEEN 1996 AND 1998 AND NOT (origin_key = 'CN' OR coalesce(quantity >= 40, false)) AND (quantity IS NOT NULL OR origin_key = 'CN')")
predicate("month_drill_down", Query().with_month("1998-01"), "date BETWEEN '1998-01-01' AND '1998-01-31'")
predicate("group_drill_down", Query().with_filter("dispatch_country", "ASIA"), "dispatch_key = 'ASIA'")

query("count", "SELECT count(*) AS rows FROM f WHERE dispatch_key = 'ASIA'")(lambda g: search.count(g, Query(filters={"dispatch_country": "asia"})))
query("page_default_order", "SELECT id, product AS product_code, value FROM f ORDER BY id DESC LIMIT 50")(lambda g: search.page(g, Query(), ("product_code", "value")))
query("page_by_date", "SELECT id, date, value FROM f WHERE year = 1997 ORDER BY date DESC, id DESC LIMIT 20 OFFSET 40")(lambda g: search.page(g, Query(filters={"year": "1997"}), ("date", "value"), limit=20, offset=40))
query("page_by_number", "SELECT id, value, net FROM f ORDER BY net ASC NULLS FIRST, id DESC LIMIT 50 OFFSET 5000")(lambda g: search.page(g, Query(), ("value", "net"), search.Sort("net"), offset=5000))
query("page_by_text", "SELECT id, description, origin_key FROM f WHERE origin_key = 'CN' ORDER BY lower(description) DESC, id DESC LIMIT 30")(
    lambda g: search.page(g, Query(filters={"origin_country": "CN"}), ("description",), search.Sort("description", True), limit=30).withColumn("origin_key", F.lit("CN"))
)
query("page_extra_column", "SELECT id, ship AS \"Ship date\" FROM f WHERE flag = 'N' ORDER BY id DESC LIMIT 10")(lambda g: search.page(g, _one("extra:Return flag", "equals", "N"), ("extra:Ship date",), search.Sort("nothing"), limit=10).select("id", "Ship date").orderBy(F.col("id").desc()))
query("record_card", "SELECT id, date, recipient, value FROM facts WHERE id = (SELECT max(id) FROM facts)")(lambda g: g.join(g.agg(F.max("id").alias("id")), "id").select("id", "date", "recipient", "value"))
query("extra_headers", "SELECT * FROM (VALUES ('return flag', 'Return flag'), ('ship date', 'Ship date')) AS t(key, header)")(search.extra_headers)
query("duplicates", "SELECT source_file, is_canonical, count(*) AS rows, 'a.csv' AS first_file FROM facts GROUP BY source_file, is_canonical")(
    lambda g: g.groupBy("source_file", "is_canonical").agg(F.count("*").alias("rows"), F.max("first_file").alias("first_file"))
)
_LEFT = "(is_canonical AND l_orderkey % 22 = 0)"
_without_owners = lambda g: g.filter(~(F.col("is_canonical") & (F.floor(F.col("id") / 10_000) % 22 == 0)))
query("orphan_duplicates", f"SELECT source_file, count(*) AS rows, min(id) AS least FROM facts WHERE NOT {_LEFT} AND NOT is_canonical AND l_orderkey % 22 = 0 GROUP BY source_file")(
    lambda g: gold_tables.orphans(_without_owners(g)).groupBy("source_file").agg(F.count("*").alias("rows"), F.min("id").alias("least"))
)
query("remarked_duplicates", f"SELECT source_file, is_canonical OR l_orderkey % 22 = 0 AS is_canonical, CASE WHEN l_orderkey % 22 = 0 THEN 'b.csv' ELSE 'a.csv' END AS first_file, count(*) AS rows FROM facts WHERE NOT {_LEFT} GROUP BY ALL")(
    lambda g: gold_tables.remarked(_without_owners(g)).groupBy("source_file", "is_canonical", "first_file").agg(F.count("*").alias("rows"))
)
query("assigned_meaning", "SELECT substr(ship, 1, 7) AS month, count(*) AS rows, '' AS left_in_extra, min(flag) AS flag FROM f GROUP BY 1")(
    lambda g: _canonical(gold_tables.assigned(g, 1, "Ship date", "date")).groupBy("month").agg(F.count("*").alias("rows"), F.max(text.extra_value(F.col("extra"), "ship date")).alias("left_in_extra"), F.min(text.extra_value(F.col("extra"), "return flag")).alias("flag"))
)
query("fixed_currency", "SELECT CASE WHEN currency_key = '__unknown__' THEN 'UAH' ELSE currency_key END AS currency, CASE WHEN unit_key = '__unknown__' THEN 'tonne' ELSE unit_key END AS unit, count(*) AS rows FROM f GROUP BY 1, 2")(
    lambda g: _canonical(gold_tables.fixed(g, 1, "hryvnia", "t")).groupBy(F.col("currency_key").alias("currency"), F.col("unit_key").alias("unit")).agg(F.count("*").alias("rows"))
)
query("currency_evidence", """
SELECT 1 AS schema_id, count(*) AS comparable, round(greatest(count(*) FILTER (WHERE net > 0 AND abs(value - rfv * net) <= 0.02 * value), count(*) FILTER (WHERE gross > 0 AND abs(value - rfv * gross) <= 0.02 * value)) / count(*), 4) AS agreement, NULL::VARCHAR AS currency
FROM facts WHERE value > 0 AND rfv > 0 AND (net > 0 OR gross > 0)""")(lambda g: gold_tables.detect_currency(g))

# Pivots


def _pivot_sql(r: str, c: str, v: str, rows: int, columns: int, chrono: bool) -> str:
    order = "c" if chrono else "t DESC, c"
    return f"""
, e AS (SELECT {r} AS r, {c} AS c, {v} AS v FROM f WHERE {r} <> '' AND {c} <> '' GROUP BY 1, 2),
rt AS (SELECT r, row_number() OVER (ORDER BY t DESC, r) AS k FROM (SELECT r, round(sum(v), 4) AS t FROM e GROUP BY r)), ct AS (SELECT c, row_number() OVER (ORDER BY {order}) AS k FROM (SELECT c, round(sum(v), 4) AS t FROM e GROUP BY c)),
x AS (SELECT CASE WHEN rt.k <= {rows} THEN r ELSE 'Others' END AS row_label, CASE WHEN ct.k <= {columns} THEN c ELSE 'Others' END AS column_label, least(rt.k, {rows + 1}) AS row_rank, least(ct.k, {columns + 1}) AS column_rank, v FROM e JOIN rt USING (r) JOIN ct USING (c))
SELECT row_label, column_label, coalesce(row_rank, 0) AS row_rank, coalesce(column_rank, 0) AS column_rank, round(sum(v), 4) AS v FROM x GROUP BY GROUPING SETS ((row_label, row_rank, column_label, column_rank), (row_label, row_rank), (column_label, column_rank), ())"""


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({"row_rank": F.col("row_rank").cast("long"), "column_rank": F.col("column_rank").cast("long")})


query("pivot_recipient_month", _pivot_sql("recipient", "month", "coalesce(sum(value), 0)", 20, 12, True))(lambda g: _long(pivot.pivot(_canonical(g), "recipient", "month")))
query("pivot_origin_trademark_rows", _pivot_sql("origin_key", "trademark", "count(*)::DOUBLE", 5, 4, False))(lambda g: _long(pivot.pivot(_canonical(g), "origin_country", "trademark", "rows", 5, 4)))
query("pivot_month_year_net", _pivot_sql("month", "CAST(year AS VARCHAR)", "coalesce(sum(net), 0)", 100, 3, True))(lambda g: _long(pivot.pivot(_canonical(g), "month", "year", "net", 100, 3)))
query("pivot_unit_mixed", "SELECT CASE WHEN count(DISTINCT currency_key) = 1 THEN min(currency_key) END AS unit FROM f")(lambda g: pivot.unit(_canonical(g)))
query("pivot_unit_single", "SELECT min(unit_key) AS unit FROM f WHERE unit_key = 'g'")(lambda g: pivot.unit(compiler.apply(g, _one("weight_unit", "equals", "g")), "net"))

# Comparisons and dossiers

_SIDE = """count(*)::DOUBLE AS row_count, count(DISTINCT nullif(declaration, ''))::DOUBLE AS declaration_count, count(DISTINCT nullif(sender, ''))::DOUBLE AS distinct_senders, count(DISTINCT nullif(recipient, ''))::DOUBLE AS distinct_recipients,
  count(DISTINCT nullif(company, ''))::DOUBLE AS distinct_companies, count(DISTINCT nullif(trademark, ''))::DOUBLE AS distinct_trademarks, count(DISTINCT nullif(product, ''))::DOUBLE AS distinct_product_codes, count(DISTINCT nullif(origin_key, ''))::DOUBLE AS distinct_origin_countries,
  count(DISTINCT nullif(dispatch_key, ''))::DOUBLE AS distinct_dispatch_countries, count(DISTINCT nullif(trade_key, ''))::DOUBLE AS distinct_trade_countries, coalesce(sum(value), 0) AS total_value, coalesce(sum(gross), 0) AS total_gross, coalesce(sum(net), 0) AS total_net, coalesce(sum(quantity), 0) AS total_quantity,
  coalesce(sum(net_kg), 0) AS total_net_kg, coalesce(sum(gross_kg), 0) AS total_gross_kg, coalesce(sum(value) / nullif(sum(net), 0), 0) AS value_per_net"""
query("compare_years", f"""
, a AS (UNPIVOT (SELECT {_SIDE} FROM f WHERE year = 1996) ON COLUMNS(*) INTO NAME metric VALUE l), b AS (UNPIVOT (SELECT {_SIDE} FROM f WHERE year = 1997) ON COLUMNS(*) INTO NAME metric VALUE r)
SELECT metric, round(l + 1e-5, 2) AS left, round(r + 1e-5, 2) AS right, CASE WHEN metric NOT IN ('total_value', 'value_per_net') THEN round(r - l + 1e-5, 2) END AS delta, CASE WHEN metric NOT IN ('total_value', 'value_per_net') AND l <> 0 THEN round((r - l) / l * 100 + 1e-5, 2) END AS delta_percent FROM a JOIN b USING (metric)""", kilograms=True)(
    lambda g: compare.compare(*[compiler.apply(g, Query(filters={"year": y})) for y in ("1996", "1997")])
)
query("overview_story", """
SELECT round(count(*) / count(DISTINCT nullif(declaration, '')), 4) AS rows_per_declaration, round(sum(value) / count(DISTINCT nullif(declaration, '')), 4) AS value_per_declaration, round(sum(net) / count(DISTINCT nullif(declaration, '')), 4) AS net_per_declaration,
  greatest(count(DISTINCT nullif(origin_key, '')), count(DISTINCT nullif(dispatch_key, '')), count(DISTINCT nullif(trade_key, ''))) AS most_countries FROM f WHERE dispatch_key = 'AFRICA'""")(
    lambda g: compare.story(compiler.apply(g, Query(filters={"dispatch_country": "AFRICA"})))
)
query("company_overview", f", p AS (SELECT * FROM f WHERE company = '00000769') SELECT {_OVERVIEW}, round(coalesce(sum(net_kg), 0), 4) AS total_net_kg, round(coalesce(sum(gross_kg), 0), 4) AS total_gross_kg, coalesce(round(sum(value) / sum(net), 4), 0) AS value_per_net FROM p")(
    lambda g: compare.company_profile(g, "00000769")["overview"]
)
query("company_names", "SELECT recipient AS name, count(*) AS rows FROM f WHERE company = '00000769' AND recipient <> '' GROUP BY recipient")(lambda g: compare.company_profile(g, "00000769")["names"])
query("company_products", ", p AS (SELECT * FROM f WHERE company = '00000769')" + _section_sql("substr(product, 1, 4)", "p"))(lambda g: compare.company_profile(g, "00000769")["product_codes"])

# Price risk: parts' types as products, list prices with discounts, some of them a tenth


def _risk_rows(g: DataFrame, origin: bool = True) -> DataFrame:
    """Brands and countries of origin are few and often empty, so that all cohort levels are met; without origins the dispatch country counts."""
    dip = F.when(F.col("declaration_number").try_cast("long") % 97 == 0, 0.1).otherwise(1.0)
    price = F.col("rmv_net") * dip
    return _canonical(g).withColumns({
        "product_code_label": F.substring_index("description", " ", -1), "value": F.round(price * F.col("net"), 6), "currency": F.col("dispatch_country_key"),
        "weight_unit": F.when(F.col("id") % 50 == 0, "").otherwise("kg"), "trademark_label": F.when(F.right("trademark_label", F.lit(1)).isin("1", "2", "3"), "Own").otherwise(""),
        "origin_country_key": F.when(F.lit(origin) & (F.col("origin_country_key") < "K"), "A").otherwise(""), "dispatch_country_key": F.left("dispatch_country_key", F.lit(1)), "country_key": F.lit(""),
    })


_QUARTILES = "count(*) AS n, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.75) AS p75"


def _risk_sql(country: str = "CASE WHEN origin_key < 'K' THEN 'A' ELSE '' END") -> str:
    cohort = "code, period, currency, unit"
    same = " AND ".join(f"{{0}}.{c} = p.{c}" for c in cohort.split(", "))
    return f"""
, raw AS (SELECT id, company, split_part(description, ' ', -1) AS code, substr(month, 1, 4) || '-Q' || CAST((CAST(substr(month, 6, 2) AS INT) + 2) // 3 AS VARCHAR) AS period, dispatch_key AS currency,
  CASE WHEN id % 50 = 0 THEN '' ELSE 'KG' END AS unit, CASE WHEN right(trademark, 1) IN ('1', '2', '3') THEN 'own' ELSE '' END AS brand, {country} AS country, round(rmv_net * (CASE WHEN l_orderkey % 97 = 0 THEN 0.1 ELSE 1.0 END) * net, 6) AS value, net FROM f),
x AS (SELECT *, CASE WHEN code = '' THEN 'c' WHEN currency = '' THEN 'm' WHEN unit = '' THEN 'u' WHEN value IS NULL OR value <= 0 THEN 'v' WHEN net IS NULL OR net <= 0 THEN 'w' ELSE '' END AS why FROM raw),
p AS (SELECT *, value / net AS price FROM x WHERE why = ''),
b AS (SELECT {cohort}, {_QUARTILES} FROM p GROUP BY ALL HAVING count(*) >= 20),
br AS (SELECT {cohort}, brand, {_QUARTILES} FROM p WHERE brand <> '' GROUP BY ALL HAVING count(*) >= 20),
c AS (SELECT {cohort}, country, {_QUARTILES} FROM p WHERE country <> '' GROUP BY ALL HAVING count(*) >= 20),
bc AS (SELECT {cohort}, brand, country, {_QUARTILES} FROM p WHERE brand <> '' AND country <> '' GROUP BY ALL HAVING count(*) >= 20),
e AS (SELECT p.*, CASE WHEN bc.n IS NOT NULL THEN 'brand_country' WHEN br.n IS NOT NULL THEN 'brand' WHEN c.n IS NOT NULL THEN 'country' ELSE 'base' END AS level,
    coalesce(bc.n, br.n, c.n, b.n) AS n, coalesce(bc.p25, br.p25, c.p25, b.p25) AS p25, coalesce(bc.med, br.med, c.med, b.med) AS med, coalesce(bc.p75, br.p75, c.p75, b.p75) AS p75
  FROM p JOIN b ON {same.format('b')} LEFT JOIN br ON {same.format('br')} AND br.brand = p.brand LEFT JOIN c ON {same.format('c')} AND c.country = p.country
  LEFT JOIN bc ON {same.format('bc')} AND bc.brand = p.brand AND bc.country = p.country),
fl AS (SELECT *, p75 - p25 AS iqr, greatest(p25 - 1.5 * (p75 - p25), 0) AS fence, greatest(med * net - value, 0) AS gap, price / med AS ratio FROM e WHERE med > 0 AND p25 >= 0 AND p75 >= p25 AND price < med * 0.5 AND price < greatest(p25 - 1.5 * (p75 - p25), 0)),
j AS (SELECT *, CASE WHEN n >= 50 AND iqr / med <= 0.5 AND level <> 'base' THEN 'high' WHEN n >= 30 AND iqr / med <= 0.75 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN ratio < 0.25 THEN 'critical' WHEN ratio < 0.4 THEN 'high' ELSE 'moderate' END AS severity,
  array_to_string(list_filter(['heuristic_not_proof', CASE WHEN n < 30 THEN 'limited_sample' ELSE '' END, CASE WHEN iqr / med > 0.5 THEN 'high_dispersion' ELSE '' END, CASE WHEN brand <> '' AND level NOT IN ('brand', 'brand_country') THEN 'brand_cohort_too_small' ELSE '' END,
    CASE WHEN country <> '' AND level NOT IN ('country', 'brand_country') THEN 'country_cohort_too_small' ELSE '' END], lambda v : v <> ''), ',') AS limitations FROM fl)
"""


_RISK = _risk_sql()
query("risk_summary", _RISK + """
SELECT (SELECT count(*) FROM x) AS query_rows, 0::BIGINT AS missing_product_code, 0::BIGINT AS missing_period, (SELECT count(*) FROM x WHERE why = 'm') AS missing_currency, (SELECT count(*) FROM x WHERE why = 'u') AS missing_weight_unit,
  (SELECT count(*) FROM x WHERE why = 'v') AS invalid_value, (SELECT count(*) FROM x WHERE why = 'w') AS invalid_weight, (SELECT count(*) FROM p) AS eligible_rows, (SELECT count(*) FROM e) AS evaluated_rows,
  (SELECT count(DISTINCT code) FROM e) AS checked_codes,
  (SELECT count(*) FROM (SELECT DISTINCT code, period, currency, unit, level, CASE WHEN level IN ('brand', 'brand_country') THEN brand END, CASE WHEN level IN ('country', 'brand_country') THEN country END FROM e)) AS checked_cohorts,
  (SELECT count(*) FROM fl) AS flagged_rows, (SELECT count(DISTINCT code) FROM fl) AS flagged_codes,
  (SELECT CASE WHEN count(DISTINCT currency) = 1 THEN round(coalesce(sum(value), 0), 4) ELSE 0 END FROM fl) AS flagged_value, (SELECT CASE WHEN count(DISTINCT currency) = 1 THEN round(coalesce(sum(gap), 0), 4) ELSE 0 END FROM fl) AS estimated_gap, (SELECT count(*) FROM p) - (SELECT count(*) FROM e) AS insufficient_cohort""")(lambda g: risk.summary(_risk_rows(g)))
query("risk_by_currency", _RISK + "SELECT currency, count(*) AS flagged_rows, round(sum(value), 2) AS flagged_value, round(sum(gap), 2) AS estimated_gap FROM fl GROUP BY currency", 2)(lambda g: risk.by_currency(_risk_rows(g)))
_AT_RISK = "SELECT id, round(price, 4) AS price, round(ratio, 4) AS ratio, round(gap, 4) AS gap, n, level, round(greatest((1 - ratio) * 100, 0), 4) AS deviation_percent, confidence, severity, limitations FROM j"


def _at_risk(rows: DataFrame) -> DataFrame:
    found = risk.rows_at_risk(rows, limit=None) if "ratio" not in rows.columns else rows
    return found.select("id", "price", "ratio", "gap", "n", "level", "deviation_percent", "confidence", "severity", F.array_join("limitations", ",").alias("limitations"))


query("risk_rows", _RISK + _AT_RISK)(lambda g: _at_risk(_risk_rows(g)))
query("risk_rows_by_dispatch_country", _risk_sql("substr(dispatch_key, 1, 1)") + _AT_RISK)(lambda g: _at_risk(_risk_rows(g, origin=False)))
query("risk_table", _RISK + _AT_RISK + " WHERE confidence <> 'low' AND currency = 'ASIA' AND code ILIKE '%gear%' ORDER BY n DESC, id")(
    lambda g: _at_risk(risk.table(risk.rows_at_risk(_risk_rows(g), limit=None).filter("confidence <> 'low'"), "n", currency="asia", part="Gear"))
)
query("risk_by_confidence", _RISK + "SELECT confidence, count(*) AS flagged_rows FROM j GROUP BY confidence")(lambda g: risk.by_confidence(_risk_rows(g)))
query("risk_by_company", _RISK + """
SELECT company, sum(n)::BIGINT AS flagged_rows, string_agg(currency || ':' || CAST(CAST(g AS DECIMAL(18,2)) AS VARCHAR), ';' ORDER BY currency) AS gaps FROM (SELECT company, currency, count(*) AS n, sum(gap) AS g FROM fl GROUP BY ALL) GROUP BY company ORDER BY flagged_rows DESC, company LIMIT 8""")(
    lambda g: risk.by_company(_risk_rows(g)).select("company", "flagged_rows", F.array_join(F.transform("gaps", lambda x: F.concat(x["currency"], F.lit(":"), x["gap"].cast("decimal(18,2)").cast("string"))), ";").alias("gaps"))
)

# Rollups

_SCOPED = ", s AS (SELECT 'occurrences' AS scope, * FROM facts UNION ALL SELECT 'canonical', * FROM f), y AS (SELECT *, 0 AS year_key FROM s UNION ALL SELECT *, year FROM s)"
_USD = """CASE WHEN count(value) = 0 THEN 0 WHEN count(*) FILTER (WHERE value IS NOT NULL AND starts_with(currency_key, '__unknown__')) = 0 AND count(DISTINCT currency_key) FILTER (WHERE value IS NOT NULL) = 1 AND min(currency_key) = 'USD' THEN round(sum(value), 4) END"""
query("rollup_overview", _SCOPED + f"""
SELECT scope, year_key, {_OVERVIEW.replace("round(coalesce(sum(value), 0), 4) AS total_value, round(coalesce(sum(gross), 0), 4) AS total_gross, round(coalesce(sum(net), 0), 4) AS total_net,", "")}, {_USD} AS total_value_usd, round(sum(gross_kg), 4) AS total_gross_kg, round(sum(net_kg), 4) AS total_net_kg,
  CASE WHEN count(*) FILTER (WHERE starts_with(currency_key, '__unknown__')) > 0 THEN 'unavailable' ELSE 'partitioned' END AS monetary_mode, CASE WHEN count(*) FILTER (WHERE net IS NOT NULL AND net_kg IS NULL) > 0 THEN 'unavailable' ELSE 'normalized_kg' END AS weight_mode
FROM y GROUP BY scope, year_key""", kilograms=True)(rollups.overview)
query("rollup_monthly", _SCOPED + f"""
SELECT scope, year_key, month, count(*) AS rows, count(DISTINCT nullif(declaration, '')) AS declarations, {_USD} AS total_value_usd, round(coalesce(sum(net_kg), 0), 4) AS total_net_kg, round(coalesce(sum(value) FILTER (WHERE net_kg > 0), 0), 4) AS paired_kg_value,
  round(coalesce(sum(net_kg) FILTER (WHERE value IS NOT NULL AND net_kg > 0), 0), 4) AS paired_kg, round(coalesce(sum(value), 0), 4) AS total_value, round(coalesce(sum(net), 0), 4) AS total_net, {_SUBSET} FROM y WHERE month <> '' GROUP BY scope, year_key, month""", kilograms=True)(rollups.monthly)
query("rollup_currencies", _SCOPED + "SELECT scope, year_key, currency_key AS currency, count(*) AS valued_rows, round(sum(value), 4) AS total_value FROM y WHERE value IS NOT NULL GROUP BY ALL")(rollups.currencies)
_LABELS_UNION = " UNION ALL ".join([f"SELECT '{k}' AS kind, 0 AS hs_level, {x} AS label, * FROM y" for k, x in _LABEL_SQL.items() if k != "product_codes"] + [f"SELECT 'product_codes', {n}, substr(product, 1, {n}), * FROM y" for n in (2, 3, 4, 5, 6, 7, 8, 10)])
query("rollup_sections", _SCOPED + f"""
SELECT scope, year_key, kind, hs_level, label, count(*) AS rows, count(DISTINCT nullif(declaration, '')) AS declarations, count(DISTINCT nullif(company, '')) AS companies, {_USD} AS total_value_usd, round(coalesce(sum(net_kg), 0), 4) AS total_net_kg, round(coalesce(sum(gross_kg), 0), 4) AS total_gross_kg,
  round(coalesce(sum(quantity), 0), 4) AS total_quantity, round(coalesce(sum(value), 0), 4) AS total_value, round(coalesce(sum(net), 0), 4) AS total_net, round(coalesce(sum(gross), 0), 4) AS total_gross, {_SUBSET} FROM ({_LABELS_UNION}) WHERE label <> '' GROUP BY scope, year_key, kind, hs_level, label""", kilograms=True)(rollups.sections)
query("rollup_price_baselines", _SCOPED + """
, p AS (SELECT *, value / net_kg AS price FROM y WHERE value IS NOT NULL AND net_kg > 0 AND NOT starts_with(currency_key, '__unknown__')),
k AS (SELECT 'all' AS kind, '' AS label, * FROM p UNION ALL SELECT 'product_code', product, * FROM p UNION ALL SELECT 'trademark', trademark, * FROM p UNION ALL SELECT 'origin_country', origin_key, * FROM p WHERE origin_key <> '')
SELECT scope, year_key, kind, label, currency_key AS currency, unit_key AS unit, count(*) AS samples, round(avg(price), 4) AS average, round(min(price), 4) AS minimum, round(max(price), 4) AS maximum, round(sum(value) / sum(net_kg), 4) AS weighted_average,
  round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.75), 4) AS p75 FROM k GROUP BY scope, year_key, kind, label, currency_key, unit_key""", kilograms=True)(rollups.price_baselines)

# Scalars over texts made from the tables


def scalar(name: str, sql: str):
    """A query over the lineitem table itself; sql is whole."""

    def add(fn: Callable[[DataFrame], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
        SQL[name] = sql

    return add


def _counts(t: DataFrame, key: F.Column, name: str = "k") -> DataFrame:
    return t.groupBy(key.alias(name)).agg(F.count("*").alias("rows"))


def _counts_sql(key: str) -> str:
    return f"SELECT {key} AS k, count(*) AS rows FROM lineitem GROUP BY 1"


scalar("scalar_excel_date", _counts_sql("strftime(l_shipdate, '%Y-%m-%d')"))(lambda t: _counts(t, dates.excel_date(_days().cast("string"))))
scalar("scalar_excel_time", _counts_sql("strftime(l_shipdate, '%Y-%m-%d') || ' 12:00:00'"))(lambda t: _counts(t, dates.excel_date((_days() + 0.5).cast("string"))))
scalar("scalar_normalize_date", _counts_sql("strftime(l_shipdate, '%Y-%m-%d')"))(lambda t: _counts(t, dates.normalize_date(F.date_format("l_shipdate", "d/M/yyyy"))))
scalar("scalar_month_key", _counts_sql("strftime(l_shipdate, '%Y-%m')"))(lambda t: _counts(t, dates.month_key(F.date_format("l_shipdate", "yyyy.M.d'T'HH:mm"))))
scalar("scalar_quarter", _counts_sql("year(l_shipdate) || '-Q' || quarter(l_shipdate)"))(lambda t: _counts(t, dates.quarter_key(F.date_format("l_shipdate", "yyyy-MM"))))
scalar("scalar_extract_year", _counts_sql("year(l_shipdate)::INT"))(lambda t: _counts(t, dates.extract_year(F.concat(F.lit("no 120245 of "), F.date_format("l_shipdate", "dd.MM.yyyy")))))
scalar("scalar_parse_year", _counts_sql("year(l_shipdate)::INT"))(lambda t: _counts(t, dates.parse_year(F.concat(F.lit("y. "), F.date_format("l_shipdate", "yyyy")))))
scalar("scalar_num_value", "SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS parsed FROM lineitem")(
    lambda t: t.select(numbers.num_value(F.concat(F.lit("$ "), F.format_number("l_extendedprice", 2)), True).alias("v")).agg(F.round(F.sum("v"), 2).alias("total"), F.count("v").alias("parsed"))
)
scalar("scalar_text_key", _counts_sql("'a ' || lower(l_returnflag)"))(lambda t: _counts(t, text.text_key(F.concat(F.lit("  A\t "), F.col("l_returnflag"), F.lit("\n")))))
scalar("scalar_label_value", _counts_sql("CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END"))(lambda t: _counts(t, text.label_value(F.when(F.col("l_returnflag") == "N", F.lit(" n/a ")).otherwise(F.col("l_returnflag")))))
scalar("scalar_formula_guard", _counts_sql("CASE l_returnflag WHEN 'A' THEN chr(39) || '=A' WHEN 'R' THEN '-5' ELSE chr(39) || '@N' END"))(
    lambda t: _counts(t, text.guard_formula(F.when(F.col("l_returnflag") == "A", "=A").when(F.col("l_returnflag") == "R", "-5").otherwise("@N")))
)
scalar("scalar_sql_quantiles", """SELECT l_returnflag AS k, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, 7.5::DOUBLE AS second FROM lineitem GROUP BY 1""")(
    lambda t: _with_functions(t).sparkSession.sql("SELECT l_returnflag AS k, round(median(p), 4) AS median, round(get(percentile(p, array(0.25, 0.75)), 0), 4) AS p25, round(get(percentile(p, array(0.25, 0.75)), 1), 4) AS p75, pctl_num('2|7.5|x', 1) AS second FROM (SELECT l_returnflag, num_value(cast(l_extendedprice AS STRING)) AS p FROM priced_lines) GROUP BY 1")
)
scalar("scalar_safe_ratio", "SELECT round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END), 4) AS r FROM lineitem")(lambda t: t.agg(F.round(F.sum(numbers.safe_ratio(F.col("l_tax"), F.col("l_discount"))), 4).alias("r")))


def _with_functions(t: DataFrame) -> DataFrame:
    registry.register_functions(t.sparkSession)
    t.createOrReplaceTempView("priced_lines")
    return t


def _days() -> F.Column:
    """Spreadsheet day number of the ship date."""
    return F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date"))


# Imports: files written from the tables are detected, read and mapped again


def imported(name: str, sql: str):
    """A query over the gold rows of a store; the function gets the session, the tables' folder and a new store."""

    def add(fn: Callable[[SparkSession, str, str], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: fn(spark, sf_dir, scratch_path(spark, "import"))
        SQL[name] = sql

    return add


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a semicolon file: dates day first, decimal commas, a quoted cell, blank lines between some."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    amount = F.replace(F.format_string("%.2f", F.col("o_totalprice").cast("double")), F.lit("."), F.lit(","))
    cells = F.concat_ws(";", F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat(F.lit("N"), "o_orderkey"), F.concat(F.lit('"'), "c_name", F.lit('; ""retail"""')), amount, F.lit("USD"), "o_orderpriority")
    after = F.when(F.col("o_orderkey") % 7 == 0, "\n").otherwise("")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("k"), F.concat(cells, after).alias("value"))


def _order_file(spark: SparkSession, sf_dir: str, where: str, head: list[str]) -> str:
    return _one_file(spark, "\n".join(head), _order_lines(spark, sf_dir), where)


def _one_file(spark: SparkSession, head: str, lines: DataFrame, where: str) -> str:
    first = spark.createDataFrame([(-1, head)], "k long, value string")
    # One file is what is imported.
    first.unionByName(lines).repartition(1).sortWithinPartitions("k").select("value").write.text(f"{where}/file")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{where}/file")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{where}/orders.csv"))
    return f"{where}/orders.csv"


_HEADER = "Order Date;Invoice No;Buyer;Amount;Currency;Priority"
_IMPORT_SQL = """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT 'N' || o_orderkey) AS declarations, count(DISTINCT c_name || '; "retail"') AS buyers, round(sum(o_totalprice), 2) AS total, 'USD' AS currency, min(o_orderpriority) AS priority
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""


def _by_month(gold: DataFrame) -> DataFrame:
    return gold.groupBy("month").agg(
        F.count("*").alias("rows"), F.count_distinct("declaration_number_label").alias("declarations"), F.count_distinct("recipient_label").alias("buyers"),
        F.round(F.sum("value"), 2).alias("total"), F.min("currency_key").alias("currency"), F.min(text.extra_value(F.col("extra"), "priority")).alias("priority"),
    )


@imported("import_delimited", _IMPORT_SQL)
def _(spark, sf_dir, where):
    ingest.import_file(spark, _order_file(spark, sf_dir, where, [_HEADER]), f"{where}/store")
    return _by_month(ingest.gold_table(spark, f"{where}/store"))


@imported("import_below_title_and_blank_lines", _IMPORT_SQL)
def _(spark, sf_dir, where):
    ingest.import_file(spark, _order_file(spark, sf_dir, where, ["Orders of all years", "", "  ", "", _HEADER, ""]), f"{where}/store")
    return _by_month(ingest.gold_table(spark, f"{where}/store"))


@imported("import_quoted_breaks", _IMPORT_SQL.replace("min(o_orderpriority)", "min(o_orderpriority || ' seen')"))
def _(spark, sf_dir, where):
    """Every row has a cell with a line break, and one with a delimiter after a break."""
    lines = _order_lines(spark, sf_dir).withColumn("value", F.concat(F.regexp_replace("value", "([^;]+?)(\n?)$", '"$1\n  seen";"a\n;""b"""$2')))
    ingest.import_file(spark, _one_file(spark, f"{_HEADER};Note", lines, where), f"{where}/store")
    return _by_month(ingest.gold_table(spark, f"{where}/store"))


@imported("import_twice_marks_duplicates", """
SELECT source_file, is_canonical, count(*) AS rows, 'orders.csv' AS first_file FROM (SELECT 'orders.csv' AS source_file, true AS is_canonical FROM orders UNION ALL SELECT 'more.csv', false FROM orders UNION ALL SELECT 'more.csv', true FROM (VALUES (1)) AS t(x))
GROUP BY ALL""")
def _(spark, sf_dir, where):
    path = _order_file(spark, sf_dir, where, [_HEADER])
    store = f"{where}/store"
    ingest.import_file(spark, path, store)
    assert ingest.import_file(spark, path, store) == {"skipped": True}
    more = _order_file(spark, sf_dir, f"{where}/more", [_HEADER, "01.01.2024;X1;New;1,00;USD;none"])
    moved = more.replace("orders.csv", "more.csv")
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.Path(more).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(more), jvm.org.apache.hadoop.fs.Path(moved))
    ingest.import_file(spark, moved, store)
    gold = ingest.gold_table(spark, store)
    return gold.groupBy("source_file", "is_canonical").agg(F.count("*").alias("rows"), F.max(F.when(~F.col("is_canonical"), F.col("first_file")).otherwise("orders.csv")).alias("first_file"))


@imported("import_workbook_serial_dates", """
SELECT s_name AS sender, strftime(DATE '2019-12-30' + CAST(s_suppkey AS INT), '%Y-%m-%d') AS date, strftime(DATE '2019-12-30' + CAST(s_suppkey AS INT), '%Y-%m') AS month, round(s_acctbal, 2) AS value, CAST(43829 + s_suppkey AS VARCHAR) AS plain_number FROM supplier""")
def _(spark, sf_dir, where):
    """Numbers in a column of dates are day numbers; the same numbers elsewhere stay numbers."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") + 43829).cast("long"), "s_name", F.col("s_acctbal").cast("double"), (F.col("s_suppkey") + 43829).cast("long"))
    book = export.xlsx_bytes([("Clearance date", "Supplier", "Amount", "Batch"), *map(tuple, rows.toLocalIterator())])  # a small workbook
    write_bytes(spark, f"{where}/book.xlsx", book)
    ingest.import_file(spark, f"{where}/book.xlsx", f"{where}/store")
    gold = ingest.gold_table(spark, f"{where}/store")
    return gold.select("sender", "date", "month", F.round("value", 2).alias("value"), text.extra_value(F.col("extra"), "batch").alias("plain_number"))


_ODS_SPACES = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{k}:1.0"' for k in ("office", "table", "text"))


def _ods_book(sheets: dict[str, list[str]]) -> bytes:
    """A workbook of sheets, each of rows in XML."""
    body = "".join(f'<table:table table:name="{name}">{"".join(rows)}</table:table>' for name, rows in sheets.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("content.xml", f"<office:document-content {_ODS_SPACES}><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>")
    return out.getvalue()


def _ods_cells(*values: str | float | None) -> str:
    cell = lambda v: "<table:table-cell/>" if v is None else f'<table:table-cell office:value-type="float" office:value="{v!r}"/>' if isinstance(v, (int, float)) else f'<table:table-cell office:value-type="string"><text:p>{xml_escape(v)}</text:p></table:table-cell>'
    return f"<table:table-row>{''.join(map(cell, values))}</table:table-row>"


@imported("import_ods_sheets", """
SELECT 'book.ods [Suppliers]' AS source_file, s_name AS sender, round(s_acctbal, 2) AS value, 1 AS rows FROM supplier UNION ALL SELECT 'book.ods [Same]', 'Twice & more', 7, 5""")
def _(spark, sf_dir, where):
    """Two sheets, one with repeated rows and cells."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name", F.col("s_acctbal").cast("double"))
    head = _ods_cells("Supplier", "Amount", "Note")
    again = _ods_cells("Twice & more", 7.0, None).replace("<table:table-row>", '<table:table-row table:number-rows-repeated="5">')
    empty = '<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    book = _ods_book({"Suppliers": [head, *[_ods_cells(r["s_name"], r["s_acctbal"], "x") for r in rows.toLocalIterator()], empty], "Same": [empty, head, again]})  # a small workbook
    write_bytes(spark, f"{where}/book.ods", book)
    ingest.import_file(spark, f"{where}/book.ods", f"{where}/store")
    return ingest.gold_table(spark, f"{where}/store").groupBy("source_file", "sender", F.round("value", 2).alias("value")).agg(F.count("*").cast("int").alias("rows"))


@imported("export_one_csv_file", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'N' || o_orderkey AS declaration_number, c_name || '; "retail"' AS recipient, round(o_totalprice, 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1997""")
def _(spark, sf_dir, where):
    """An export in one file, written by parts and read again."""
    engine = Engine(spark, f"{where}/store")
    engine.ingest(_order_file(spark, sf_dir, where, [_HEADER]))
    engine.export_csv(Query(filters={"year": "1997"}), ["date", "declaration_number", "recipient", "value"], f"{where}/out.csv", search.Sort("value", True))
    out = spark.read.options(sep=";", header=True, quote='"', escape='"').csv(f"{where}/out.csv")
    return out.select("date", "declaration_number", "recipient", F.round(F.col("value").cast("double"), 2).alias("value"))


@imported("export_workbook_and_import", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT o_custkey) AS buyers, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1""")
def _(spark, sf_dir, where):
    """A saved query's rows as a workbook, which is imported again."""
    engine = Engine(spark, f"{where}/store")
    engine.ingest(_order_file(spark, sf_dir, where, [_HEADER]))
    engine.save_query("a year", Query(filters={"year": "1997"}))
    engine.export_xlsx(engine.saved_query("a year"), ["date", "declaration_number", "recipient", "value"], f"{where}/out.xlsx")
    again = Engine(spark, f"{where}/again")
    again.ingest(f"{where}/out.xlsx")
    return again.gold.groupBy("month").agg(F.count("*").alias("rows"), F.count_distinct("recipient_label").alias("buyers"), F.round(F.sum("value"), 2).alias("total"))


@imported("rollups_follow_imports", """
WITH o AS (SELECT 'N' || o_orderkey AS declaration, c_name || '; "retail"' AS buyer FROM orders JOIN customer ON o_custkey = c_custkey), p AS (SELECT * FROM o UNION ALL SELECT 'X1', 'New'),
a AS (SELECT 'built' AS step, * FROM o UNION ALL SELECT 'imported', * FROM p UNION ALL SELECT 'compacted', * FROM p)
SELECT step, 'rollups' AS source, count(*) AS row_count, count(DISTINCT declaration) AS declarations, count(DISTINCT buyer) AS buyers, count(DISTINCT buyer) AS sections, count(*) AS section_rows FROM a GROUP BY step""")
def _(spark, sf_dir, where):
    """Key numbers and sections come from the rollups, right after an import and a rewrite too."""
    engine = Engine(spark, f"{where}/store")

    def answer(step: str) -> DataFrame:
        found, source = engine.overview_row(Query())
        sections = engine.rollup("sections").filter("scope = 'canonical' AND year_key = 0 AND kind = 'recipients'").agg(F.count("*").alias("sections"), F.sum("rows").alias("section_rows"))
        row = found.select(F.lit(step).alias("step"), F.lit(source).alias("source"), "row_count", F.col("declaration_count").alias("declarations"), F.col("distinct_recipients").alias("buyers"))
        return row.crossJoin(F.broadcast(sections))  # a row each

    engine.ingest(_order_file(spark, sf_dir, where, [_HEADER]), ingest.ImportOptions(weight_unit="kg"))
    engine.build_rollups()
    built = answer("built")
    write_bytes(spark, f"{where}/one.csv", f"{_HEADER}\n01.01.2024;X1;New;1,00;USD;none\n".encode())
    engine.ingest(f"{where}/one.csv", ingest.ImportOptions(weight_unit="kg"))
    imported_ = answer("imported")
    engine.compact(2)
    return built.unionByName(imported_).unionByName(answer("compacted"))


@imported("imports_follow_schema_edits", """
WITH o AS (SELECT 'orders.csv' AS source_file, o_orderpriority AS trademark, o_totalprice AS value FROM orders UNION ALL SELECT 'more.csv', 'none', 1 UNION ALL SELECT 'more.csv', o_orderpriority, o_totalprice FROM orders)
SELECT source_file, trademark, 'kg' AS unit, count(*) AS rows, sum(CASE WHEN source_file = 'orders.csv' OR trademark = 'none' THEN 1 ELSE 0 END) AS firsts, round(sum(value), 2) AS total, 0 AS left_in_extra FROM o GROUP BY 1, 2""")
def _(spark, sf_dir, where):
    """A column is given a meaning and rows a unit; the next import of the layout has both, and its duplicates are found."""
    engine = Engine(spark, f"{where}/store")
    engine.ingest(_order_file(spark, sf_dir, where, [_HEADER]))
    engine.assign(1, "Priority", "trademark")
    engine.fix(1, weight_unit="kg")
    more = _order_file(spark, sf_dir, f"{where}/more", [_HEADER, "01.01.2024;X1;New;1,00;USD;none"])
    fs, path = snapshots.hadoop(spark, more)
    fs.rename(path(more), path(more.replace("orders.csv", "more.csv")))
    engine.ingest(more.replace("orders.csv", "more.csv"))
    return engine.gold.groupBy("source_file", "trademark", F.col("unit_key").alias("unit")).agg(
        F.count("*").alias("rows"), F.sum(F.col("is_canonical").cast("int")).alias("firsts"), F.round(F.sum("value"), 2).alias("total"), F.sum(F.size("extra")).alias("left_in_extra")
    )


@imported("search_by_token_files", """
SELECT c_name || '; "retail"' AS recipient, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name LIKE '%#00000001%' GROUP BY 1""")
def _(spark, sf_dir, where):
    """Rows of many files, of which only those with the tokens are read."""
    engine = Engine(spark, f"{where}/store")
    engine.ingest(_order_file(spark, sf_dir, where, [_HEADER]))
    engine.compact(8)
    return engine.rows(Query("Retail 00000001*")).groupBy("recipient").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@imported("search_extra_by_type", """
SELECT o_orderpriority AS priority, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders
WHERE round(o_totalprice / 8, 2) BETWEEN 1000.5 AND 20000 AND o_orderdate + INTERVAL 30 DAY >= DATE '1997-01-31' GROUP BY 1""")
def _(spark, sf_dir, where):
    """Two columns without a meaning, decimal commas and dates day first, are compared as numbers and dates; files that can't have hits aren't read."""
    engine = Engine(spark, f"{where}/store")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderdate")
    insured = F.replace(F.format_string("%.2f", F.round(F.col("o_totalprice").cast("double") / 8, 2)), F.lit("."), F.lit(","))
    lines = _order_lines(spark, sf_dir).join(orders, "k").select("k", F.concat(F.rtrim(F.regexp_replace("value", "\n", "")), F.lit(";"), insured, F.lit(";"), F.date_format(F.date_add("o_orderdate", 30), "dd.MM.yyyy")).alias("value"))
    engine.ingest(_one_file(spark, f"{_HEADER};Insured amount of cargo;Release date of cargo", lines, where))
    engine.compact(8)
    q = Query(advanced=Group("and", [Condition("extra:Insured amount of cargo", "range", ["1 000,5", "20000"]), Condition("schema:1:extra:Release date of cargo", "range", ["31.01.1997", ""])]))
    return engine.rows(q).groupBy(text.extra_value(F.col("extra"), "priority").alias("priority")).agg(F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top ten senders of a year with their shares."""
    return QUERIES["top_senders_of_year"](spark, sf_dir)

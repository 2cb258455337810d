"""The scalar functions for SQL users, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dates, keys, numbers, text

SCALARS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "num_value": (numbers.num_value, "DOUBLE"),
    "num_value_grouped": (lambda c: numbers.num_value(c, grouped=True), "DOUBLE"),
    "country_key": (keys.country_key, "STRING"),
    "currency_key": (keys.currency_key, "STRING"),
    "unit_key": (keys.unit_key, "STRING"),
    "text_key": (text.text_key, "STRING"),
    "label_value": (text.label_value, "STRING"),
    "month_key": (dates.month_key, "STRING"),
    "extract_year": (dates.extract_year, "INT"),
    "normalize_date": (dates.normalize_date, "STRING"),
}


def register_functions(spark: SparkSession) -> None:
    """Registers each scalar, cyr_contains(text, lowered part), extra_values_text and pctl_num(text, i): the i-th of numbers between `|`.

    Python never runs on executors: bodies are the SQL text of the same expressions.  Medians and
    percentiles with linear interpolation are Spark's own aggregates `median` and `percentile`.
    """
    for name, (build, kind) in SCALARS.items():
        # The analysed expression knows its own SQL text.
        plan = spark.sql("SELECT cast(null AS STRING) AS x").select(build(F.col("x")).alias("v"))._jdf.queryExecution().analyzed()
        body = plan.projectList().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cyr_contains(x STRING, part STRING) RETURNS BOOLEAN RETURN coalesce(contains(lower(x), part), false)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extra_values_text(x ARRAY<STRUCT<header: STRING, value: STRING>>) RETURNS STRING RETURN array_join(transform(coalesce(x, array()), p -> p.value), ' ')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pctl_num(x STRING, i INT) RETURNS DOUBLE RETURN try_cast(get(split(x, '[|]'), i) AS DOUBLE)")

"""Nine analysis scenarios over the gold table of the generated data, and its import rate.

Each scenario runs once to warm up and REPEAT times; a query's figure is its mean in
seconds.  The gold table is derived from Parquet tables first, timed as gold rows a second; the ingest rate is that of a delimited file.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

WARMUPS, REPEAT = 1, int(os.environ.get("BENCH_REPEAT", 3))


def scenarios(gold):
    from tabulark.operators import measures, pivot, prices, risk, search, series
    from tabulark.plans import compiler
    from tabulark.plans.query import Query

    rows = compiler.apply(gold, Query())
    return {
        "search_count": lambda: search.count(gold, Query("widget")),
        "first_page": lambda: search.page(gold, Query("widget"), limit=100),
        "overview": lambda: measures.overview(rows),
        "companies": lambda: series.section(rows, "recipients", 10),
        "products": lambda: series.section(rows, "product_codes", 10, hs_level=10),
        "countries": lambda: series.section(rows, "origin_countries", 10),
        "prices": lambda: prices.metrics(rows),
        "pivot": lambda: pivot.pivot(rows, "recipient", "month", "value", 20, 12),
        "price_risk": lambda: risk.summary(rows),
    }


def import_rate(spark, sf_dir: str) -> int:
    """Rows a second of importing one delimited file of all orders: detected, parsed, cleaned, marked, written with its token table and logged."""
    from tabulark import queries
    from tabulark.sources import ingest
    from tabulark.storage import scratch_path

    where = scratch_path(spark, "bench")
    path = queries._order_file(spark, sf_dir, where, [queries._HEADER])
    began = time.time()
    source = ingest.import_file(spark, path, f"{where}/store")["sources"][0]
    return round((source["inserted"] + source["duplicates"]) / (time.time() - began))


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from tabulark import testdata

    began = time.time()
    gold = testdata.facts(spark, sf_dir)
    n = gold.count()
    ingest = time.time() - began
    took, extremes, output = {}, {}, {}
    for name, build in scenarios(gold).items():
        runs = []
        for i in range(WARMUPS + REPEAT):
            t = time.time()
            output[name] = len(build().collect())  # a page, a ranking or a few rows of totals
            if i >= WARMUPS:
                runs.append(time.time() - t)
        took[name], extremes[name] = round(sum(runs) / len(runs), 3), [round(min(runs), 3), round(max(runs), 3)]
    imported = import_rate(spark, sf_dir)
    print(json.dumps({"metric": "trade_scenarios_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "rows": n, "min_max": extremes, "output_rows": output, "gold_rows_per_s": round(n / ingest), "ingest_rows_per_s": imported}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Plans and parts stay bounded where values, rows or cells are skewed."""

import csv
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulark.operators import quantiles, risk
from tabulark.sources import delimited, ingest, records


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_breaks_in_splits(spark, tmp_path, ending):
    """Cells with breaks, delimiters and quotes, cut apart by the borders of many splits."""
    rng = np.random.default_rng(len(ending))
    rows = [[f"r{i}", *("".join(rng.choice(list('ab;"\n é'), rng.integers(0, 12))) for _ in range(3))] for i in range(300)]
    rows[150][2] = "long\n" * 300  # longer than some splits
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator=ending).writerows(rows)
    (tmp_path / "x.csv").write_text(out.getvalue(), newline="")
    where = f"file://{tmp_path}/x.csv"
    spark.conf.set("spark.sql.files.maxPartitionBytes", 600)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert spark.read.text(where).rdd.getNumPartitions() > 10
        got = delimited.read(spark, where, ";").orderBy("line").collect()
        assert [[c or "" for c in r[1:5]] for r in got] == rows and len(got[0]) == 5
        assert [r["line"] for r in got[:3]] == [0, 1, 2]
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")


def test_quotes_open_a_cell_at_its_start_only():
    assert not records.ends_inside('5" pipe;x', ";", False) and not records.ends_inside('x";"a"', ";", False)
    assert records.ends_inside('a;"b', ";", False) and records.ends_inside('b";"c', ";", True) and records.ends_inside('b""', ";", True)
    assert not records.ends_inside('"a""b";c', ";", False) and not records.ends_inside('b"x"y;z', ";", True)


def test_a_stray_quote_and_blank_records(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Supplier;Amount;Note\n\n;;\nA;1;5" pipe\n"";"";\nB;2;"two\nlines"\n')
    ingest.import_file(spark, f"file://{tmp_path}/s.csv", f"file://{tmp_path}/store")
    rows = ingest.gold_table(spark, f"file://{tmp_path}/store").orderBy("id").collect()
    assert [(r["sender"], r["value"], r["extra"][0]["value"]) for r in rows] == [("A", 1.0, '5" pipe'), ("B", 2.0, "two lines")]


def test_too_many_columns_are_an_error(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n" + "1,2\n" * 80 + "," * 16_384 + "x\n")
    with pytest.raises(ValueError, match="columns"):
        delimited.read(spark, f"file://{tmp_path}/wide.csv", ",")


@pytest.mark.parametrize("few", [True, False])
def test_quartiles_of_narrow_values_rank_few(spark, monkeypatch, few):
    """A third of all rows are different values in one bucket; what is ranked at the end is small."""
    monkeypatch.setattr(quantiles, "SMALL", 500)
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "narrow").when(F.col("id") % 3 == 1, "same").otherwise("wide").alias("k"),
        F.when(F.col("id") % 3 == 0, 100 + (F.col("id") * 7919 % 60_000) * 5e-7).when(F.col("id") % 3 == 1, 7.0).otherwise(F.pow(F.lit(1.0007), F.col("id") % 20_011) - 3000).alias("v"),
    )
    got = {r["k"]: r for r in quantiles.quartiles_by(rows, ["k"], "v", few=few).collect()}
    for k, values in rows.toPandas().groupby("k")["v"]:
        assert got[k]["n"] == len(values) and np.allclose([got[k][q] for q in quantiles.POINTS], np.percentile(values, [25, 50, 75]), rtol=1e-15)
    x = rows.withColumn("bucket", quantiles.bucket(F.col("v")))
    parts = quantiles.chosen_parts(x, ["k"], few).collect()
    assert max(r["c"] for r in parts if r["lo"] < r["hi"]) <= 500 and len(parts) <= 18


def test_one_join_of_the_rows_in_the_risk_screen(spark):
    """Rows meet the statistics of all levels once, in a join that Spark can split."""
    from support import SMALL

    from tabulark import queries, testdata

    screen = risk.screened(queries._risk_rows(testdata.facts(spark, SMALL)))
    assert screen.filter("level IS NOT NULL").count() > 0
    plan = screen._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("code_key#", plan.index("Join "))]
    assert above.count("Join ") == 1 and " LeftOuter" in above

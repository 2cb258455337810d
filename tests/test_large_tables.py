"""What only showed on larger tables: ties of sums, more rows than a sheet holds, late day numbers."""

from pyspark.sql import functions as F
from support import SMALL

from tabulark import queries, testdata
from tabulark.operators import export, pivot, series
from tabulark.plans.query import Query
from tabulark.sources import gold, ingest, workbook


def test_equal_sums_rank_by_label(spark):
    """Sums that differ only by the order of adding are ties, which the label decides."""
    sums = [("z", v) for v in (0.1, 0.2, 0.3)] + [("a", 0.6)]
    rows = spark.createDataFrame([(label, "d", "c", v, 3.0 if label == "a" else 1.0, 1.0, 1.0, "USD", "2020-01") for label, v in sums], "recipient_label string, declaration_number_label string, company_code_label string, value double, net double, gross double, quantity double, currency_key string, month string").coalesce(1)
    top = series.section(rows, "recipients")
    assert [r["label"] for r in top.filter("total_value > 0.6").collect()] == ["z"]
    rows = rows.withColumn("value", F.when(F.col("recipient_label") == "a", 0.6).otherwise(F.col("value")))
    more_rows = rows.withColumn("net", F.lit(0.0)).unionByName(rows.filter("recipient_label = 'a'").withColumns({"value": F.lit(0.0), "net": F.lit(0.0)}).crossJoin(spark.range(2)).drop("id"))
    assert [r["label"] for r in series.section(more_rows, "recipients").orderBy(F.monotonically_increasing_id()).collect()] == ["a", "z"]
    for by in ("share", "value"):
        assert [r["label"] for r in series.sorted_groups(top, by).collect()] == ["a", "z"]
    ranks = {r["row_label"]: r["row_rank"] for r in pivot.pivot(rows, "recipient", "month").collect()}
    assert (ranks["a"], ranks["z"]) == (1, 2)


def test_late_day_numbers_in_columns_of_dates(spark, tmp_path):
    book = export.xlsx_bytes([("Clearance date", "Supplier", "Amount", "Lot"), (60000, "A", 1, 60001), (60001, "B", 2, 60001), (2958465, "C", 3, 7), (2958466, "D", 4, 7), (24999, "E", 5, 7)])
    (tmp_path / "s.xlsx").write_bytes(book)
    ingest.import_file(spark, f"file://{tmp_path}/s.xlsx", f"file://{tmp_path}/store")
    rows = ingest.gold_table(spark, f"file://{tmp_path}/store").orderBy("id").collect()
    assert [r["date"] for r in rows] == ["2064-04-08", "2064-04-09", "9999-12-31", "2958466", "24999"]
    assert [r["extra"][0]["value"] for r in rows] == ["60001", "60001", "7", "7", "7"]


def test_a_workbook_goes_on_in_further_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "MOST_XLSX_ROWS", 2)
    (tmp_path / "c.csv").write_text("Company;Amount;SKU\n" + "".join(f"c{i};{i};s{i}\n" for i in range(1, 6)))
    ingest.import_file(spark, f"file://{tmp_path}/c.csv", f"file://{tmp_path}/store")
    path = str(tmp_path / "out.xlsx")
    assert export.write_xlsx(ingest.gold_table(spark, f"file://{tmp_path}/store"), Query(), ["product_code", "value"], path) == 5
    sheets = [(n, list(r)) for n, r in workbook.sheets((tmp_path / "out.xlsx").read_bytes())]
    assert [n for n, _ in sheets] == ["Export", "Export 2", "Export 3"] and all(r[0] == ["product_code", "value"] for _, r in sheets)
    assert [r[0] for _, rows in sheets for r in rows[1:]] == ["s5", "s4", "s3", "s2", "s1"]
    report = ingest.import_file(spark, f"file://{path}", f"file://{tmp_path}/again")
    assert sorted(s["name"] for s in report["sources"]) == ["out.xlsx [Export 2]", "out.xlsx [Export 3]", "out.xlsx [Export]"]
    assert sorted(r["value"] for r in ingest.gold_table(spark, f"file://{tmp_path}/again").collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_slices_of_orders_give_the_same_rows(spark, monkeypatch):
    """Large tables are marked a slice of the orders after the other, without a shuffle by contents; queries then derive the columns of the gold table."""
    whole = testdata.facts(spark, SMALL)
    monkeypatch.setattr(testdata, "_STORE", {})
    monkeypatch.setattr(testdata, "SLICED_ROWS", 1)
    monkeypatch.setattr(testdata, "SLICES", 3)
    sliced = testdata.derived_facts(spark, SMALL)
    assert sorted(sliced.columns) == sorted(whole.columns)
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(whole.columns)).cast("decimal(38,0)"))).first()
    assert digest(sliced) == digest(whole)
    plan = gold.marked_raw(testdata.raw_rows(spark, SMALL, 1, 3), "order_key")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row_hash" not in plan and "hashpartitioning(schema_id" not in plan and "hashpartitioning(order_key" not in plan


def test_queries_leave_the_whole_gold_table_unwritten(spark, monkeypatch):
    """A query writes the raw rows with their marks only, not every derived column."""
    monkeypatch.setattr(testdata, "_STORE", {})
    assert queries.QUERIES["where_empty"](spark, SMALL).first()["rows"] > 0
    (where,) = testdata._STORE.values()
    assert not {"tokens", "row_hash", "month"} & set(spark.read.parquet(where).columns)

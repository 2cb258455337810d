import pytest
from pyspark.sql import functions as F

from tabulark.operators import export, measures, series
from tabulark.operators.search import Sort
from tabulark.plans.query import Query, QueryError
from tabulark.sources import delimited, detection, ingest, workbook
from tabulark.streaming import incremental


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return f"file://{path}"


def test_detection_finds_header_below_a_title():
    rows = [["Warehouse list, spring", "", ""], ["Invoice date", "Shipper", "Total amount"], ["2023-04-11", "Nordholm", "8,100"], ["2023-04-12", "Kaivo", "7 050"]]
    t = detection.detect_table(rows)
    assert t.header_row == 1 and t.meanings == {0: "date", 1: "sender", 2: "value"}
    assert detection.detect_table([[], ["", ""]]) is None


def test_detection_of_repeated_headers():
    rows = [["Одержувач", "Одержувач", "Номер декларації", "Номер декларації", ""], ["40800911", "ПП Зоря", "L7", "23", "x"], ["40800912", "ПП Обрій", "L8", "23", "y"]]
    t = detection.detect_table(rows)
    assert t.headers == ["Одержувач", "Одержувач (2)", "Номер декларації", "Номер декларації (2)", "Column 5"]
    assert t.meanings == {0: "company_code", 1: "recipient", 2: "declaration_number", 3: "declaration_number"}


def test_weak_names_need_fitting_samples():
    assert detection.detect_table([["Amount", "Label"], ["many", "a"], ["few", "b"]]).meanings == {}


def test_labels_and_numbers_of_headers():
    assert detection.is_label("Net weight, kg") and not detection.is_label("24UA100110000101U1") and not detection.is_label("2024") and not detection.is_label("x" * 121)
    assert detection.is_number("1 250,5") and detection.is_number("-3e2") and not detection.is_number("1.2.3") and not detection.is_number("1,,234") and not detection.is_number("12 kg")
    # Weak names are confirmed by what values are read as later.
    assert detection.detect_table([["Amount", "Label"], ["1.234,56", "a"], ["1 200.75 USD", "b"]]).meanings == {0: "value"}


def test_sniffing():
    assert delimited.sniff("a;b;c\n1;2;3\n") == ";" and delimited.sniff("a\tb\n1\t2\n") == "\t" and delimited.sniff("x\ny\n", "tsv") == "\t"


CSV = '﻿Order Date;Invoice No;Supplier;Buyer;SKU;Amount;Net weight;Currency;Weight unit;Note\n15.03.2024;N1;ACME;Beta;8504;"1 200,50";10;USD;kg;"two\nlines"\n16.03.2024;N2;ACME;Beta;8504;300,25;2,5;USD;kg;\n16.03.2024;N2;ACME;Beta;8504;300,25;2,5;USD;kg;\n;;;;;;;;;\n'


def test_import_csv_twice_and_dedup(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    report = ingest.import_file(spark, write(tmp_path / "a.csv", CSV), where)
    source = report["sources"][0]
    assert (source["inserted"], source["duplicates"], source["recognised"]) == (2, 1, 9)
    assert ingest.import_file(spark, write(tmp_path / "again.csv", CSV), where) == {"skipped": True}
    more = CSV.replace("N1", "N9", 1)
    assert ingest.import_file(spark, write(tmp_path / "b.csv", more), where)["sources"][0]["duplicates"] == 2
    gold = spark.read.parquet(f"{where}/gold")
    assert gold.count() == 6 and gold.filter("is_canonical").count() == 3
    one = measures.overview(gold.filter("is_canonical")).first()
    assert one["total_value"] == pytest.approx(1200.5 * 2 + 300.25) and one["total_net"] == 22.5
    months = series.months(gold.filter("is_canonical")).collect()
    assert [m["month"] for m in months] == ["2024-03"]
    assert gold.filter("declaration_number = 'N1'").select(F.col("extra")[0]["value"]).first()[0] == "two lines"
    assert gold.filter("source_file = 'b.csv' AND NOT is_canonical").select("first_file").distinct().first()[0] == "a.csv"


@pytest.mark.parametrize("quoted", ["plain", '"two\nlines"'])
def test_blank_lines_lose_no_rows(spark, tmp_path, quoted):
    """Blank lines above the header and between rows, where the file is read in splits and where it isn't."""
    body = "".join(f"S{i};{i},50;{quoted}\n{chr(10) if i % 3 == 0 else ''}" for i in range(1, 8))
    where = f"file://{tmp_path}/store"
    report = ingest.import_file(spark, write(tmp_path / "b.csv", f"\n  \n\nSupplier;Amount;Note\n\n{body}"), where)
    assert report["sources"][0]["inserted"] == 7 and report["sources"][0]["header_row"] == 1
    assert sorted(r["sender"] for r in ingest.gold_table(spark, where).collect()) == [f"S{i}" for i in range(1, 8)]


def test_a_file_in_splits(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    path = write(tmp_path / "large.csv", "Title\n\nSupplier,Amount\n" + "".join(f"S{i},{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        records = delimited.read(spark, path, ",")
        assert records.rdd.getNumPartitions() > 1
        assert ingest.import_file(spark, path, where)["sources"][0]["inserted"] == 5000
        gold = ingest.gold_table(spark, where)
        assert [r["sender"] for r in gold.orderBy("id").limit(3).collect()] == ["S0", "S1", "S2"] and gold.select("id").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_that_no_snapshot_names_are_not_seen(spark, tmp_path):
    """Gold rows that a stopped import left behind."""
    where = f"file://{tmp_path}/store"
    ingest.import_file(spark, write(tmp_path / "a.csv", CSV), where)
    spark.read.parquet(f"{where}/gold/part=0/schema_id=1").drop("g").write.parquet(f"{where}/gold/part=1/schema_id=1/g=g-left")
    assert ingest.gold_table(spark, where).count() == 3
    ingest.import_file(spark, write(tmp_path / "b.csv", CSV.replace("N1", "N9")), where)
    gold = ingest.gold_table(spark, where)
    assert gold.count() == 6 and gold.filter("is_canonical").count() == 3


def test_serial_dates_of_workbooks(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(export.xlsx_bytes([("Invoice date", "Supplier", "Amount", "Ship date", "Lot"), (45000, "A", 2, 45000.25, 45000), ("27.11.2023", "B", 3, "later", 7)]))
    ingest.import_file(spark, f"file://{tmp_path}/s.xlsx", f"file://{tmp_path}/store")
    rows = ingest.gold_table(spark, f"file://{tmp_path}/store").orderBy("id").collect()
    assert [(r["date"], r["month"]) for r in rows] == [("2023-03-15", "2023-03"), ("2023-11-27", "2023-11")]
    assert [[e["value"] for e in r["extra"]] for r in rows] == [["2023-03-15 06:00:00", "45000"], ["later", "7"]]


def test_fixed_values_overrides_and_preview(spark, tmp_path):
    path = write(tmp_path / "p.csv", "Item,Amount,Net weight\nx,10,2\ny,20,4\n")
    preview = ingest.preview(spark, path)[0]
    assert preview.header_row == 1 and [c[2] for c in preview.columns] == [None, "value", "net_weight"]
    where = f"file://{tmp_path}/store"
    ingest.import_file(spark, path, where, ingest.ImportOptions({0: "description"}, "EUR", "kg"))
    row = spark.read.parquet(f"{where}/gold").orderBy("id").first()
    assert (row["description"], row["currency_key"], row["net_kg"]) == ("x", "EUR", 2.0)
    with pytest.raises(ValueError):
        ingest.import_file(spark, path, f"{where}2", ingest.ImportOptions({0: "value"}))
    with pytest.raises(ValueError):
        ingest.ImportOptions(currency="x" * 40)


def test_late_columns_survive(spark, tmp_path):
    path = write(tmp_path / "late.csv", "a,b\n" + "1,2\n" * 80 + "1,2,3\n")
    assert delimited.read(spark, path, ",").columns == ["line", "c0", "c1", "c2"]


def test_exports_round_trip(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    ingest.import_file(spark, write(tmp_path / "c.csv", "Company;Amount;SKU\nZulu;2;=x\nAlpha;10;85\nBeta;1;86\n"), where)
    gold = spark.read.parquet(f"{where}/gold")
    fields = ["product_code", "value"]
    assert export.write_csv_file(gold, Query(), fields, str(tmp_path / "out.csv"), Sort("value", True)) == 3
    assert (tmp_path / "out.csv").read_bytes() == "﻿product_code;value\r\n85;10.0\r\n'=x;2.0\r\n86;1.0\r\n".encode()
    assert export.write_xlsx(gold, Query(), fields, str(tmp_path / "out.xlsx"), Sort("value")) == 3
    (name, rows), = [(n, list(r)) for n, r in workbook.sheets((tmp_path / "out.xlsx").read_bytes())]
    assert name == "Export" and rows == [["product_code", "value"], ["86", "1"], ["=x", "2"], ["85", "10"]]
    export.write_csv(gold, Query(), fields, f"{where}/csv")
    assert spark.read.csv(f"{where}/csv", sep=";", header=True).count() == 3
    for bad in ([], ["value", "value"], ["nothing"]):
        with pytest.raises(QueryError):
            export.selected(gold, Query(), bad)
    with pytest.raises(QueryError):
        export.selected(gold, Query(), fields, Sort("nothing"))
    text = export.table_text(gold.select("product_code", F.lit("a;b").alias("note")).orderBy("product_code"))
    assert text.startswith("\ufeffproduct_code;note\r\n85;\"a;b\"") and "\r\n'=x;" in text and not export.table_text(gold.select("id"), delimiter="\t").startswith("\ufeff")
    assert "| row_count |" in export.report("R", measures.basis(gold).select("row_count"), {}, measures.basis(gold)).replace("  ", " ")


def test_import_workbook(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    ingest.import_file(spark, write(tmp_path / "c.csv", "SKU;Amount;Supplier\n8504;2;A\n8505;10;B\n"), where)
    export.write_xlsx(spark.read.parquet(f"{where}/gold"), Query(), ["product_code", "value", "sender"], str(tmp_path / "book.xlsx"))
    report = ingest.import_file(spark, f"file://{tmp_path}/book.xlsx", f"{where}2")
    assert report["sources"][0]["inserted"] == 2
    assert {r["product_code"] for r in spark.read.parquet(f"{where}2/gold").collect()} == {"8504", "8505"}


def test_ods_repeats_notes_and_nested_tables():
    from tabulark.queries import _ods_book, _ods_cells

    row = lambda *cells: f"<table:table-row>{''.join(cells)}</table:table-row>"
    text_cell = '<table:table-cell table:number-columns-repeated="2" office:value-type="string"><text:p>a<text:s text:c="2"/>b<text:tab/>c</text:p><text:p>d</text:p></table:table-cell>'
    nested = '<table:table-cell><text:p>out</text:p><table:table table:name="in"><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell></table:table-row></table:table></table:table-cell>'
    note = '<table:table-cell office:value-type="string"><office:annotation><text:p>note</text:p></office:annotation><text:p>seen</text:p></table:table-cell>'
    dated = '<table:table-cell office:value-type="date" office:date-value="2024-02-03T10:00:00"/><table:table-cell office:value-type="boolean" office:boolean-value="true"/>'
    book = _ods_book({"One": [row(text_cell, "<table:covered-table-cell/>", note), row(nested), row(dated)], "Two": [_ods_cells("only", 2.0)]})
    found = workbook.sheets(book)
    name, rows = next(found)
    assert (name, next(rows)) == ("One", ["a  b\tc d", "a  b\tc d", "", "seen"])  # the rest is passed over when the next sheet is asked for
    assert [(n, list(r)) for n, r in found] == [("Two", [["only", "2"]])]
    assert [list(r) for _, r in workbook.sheets(book)] == [[["a  b\tc d", "a  b\tc d", "", "seen"], ["out"], ["2024-02-03 10:00:00", "TRUE"]], [["only", "2"]]]
    wide = row(text_cell.replace('repeated="2"', 'repeated="20000"'))
    with pytest.raises(ValueError, match="columns"):
        list(next(workbook.sheets(_ods_book({"W": [wide]})))[1])
    with pytest.raises(ValueError, match="cells"):
        list(next(workbook.sheets(_ods_book({"W": [_ods_cells("x").replace("<table:table-row>", '<table:table-row table:number-rows-repeated="999999999">')]})))[1])


def test_stream_equals_batch(spark, tmp_path):
    from support import SMALL

    from tabulark.sources import gold
    from tabulark.testdata import raw_rows

    raw = raw_rows(spark, SMALL).filter("id % 40 = 1")
    for i in range(2):
        raw.filter(F.floor(F.pmod("id", F.lit(200)) / 100) == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    q = incremental.ingest_stream(spark, f"file://{tmp_path}/in", raw.schema, f"file://{tmp_path}/gold", f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/gold")
    want = gold.to_gold(raw)
    assert got.count() == want.count() and got.filter("is_canonical").count() == want.filter("is_canonical").count()


def test_event_windows(spark, duck):
    from support import SMALL, same

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    got = incremental.windowed(events).select("start", "event_type", "events", F.round("value", 2).alias("value"))
    same(got, duck.sql("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL"))

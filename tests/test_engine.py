import shutil

import pytest

from tabulark.__main__ import main
from tabulark.engine import Engine
from tabulark.operators import rollups
from tabulark.plans.query import Condition, Group, Query
from tabulark.sources import snapshots, token_index


def test_engine_from_import_to_report(spark, tmp_path):
    lines = ["Order Date;Invoice No;Supplier;Buyer;SKU;Amount;Net weight;Currency;Weight unit"]
    lines += [f"{1 + i % 28:02d}.0{1 + i % 3}.2024;N{i};S{i % 3};B{i % 4};85{i % 2}0;{100 + i},50;{1 + i % 5};USD;kg" for i in range(60)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.ingest(f"file://{tmp_path}/t.csv")["sources"][0]["inserted"] == 60
    q = Query(filters={"year": "2024"})
    assert engine.count(q) == 60 and engine.count(Query(advanced=Condition("value", "range", ["100", "109.5"]))) == 10
    assert engine.count(Query(snapshot=engine.snapshot() - 1)) == 59
    parts = engine.analytics(q, "companies")
    assert parts["overview"].first()["distinct_senders"] == 3 and [r["label"] for r in parts["recipients"].collect()] == ["B3", "B2", "B1", "B0"]
    assert set(engine.previews(q)) == {"basis", "companies", "products", "countries"}
    long, unit = engine.pivot(q, "sender", "month")
    assert unit.first()["unit"] == "USD" and long.filter("row_label IS NULL AND column_label IS NULL").first()["v"] == sum(100.5 + i for i in range(60))
    engine.build_rollups()
    row, source = engine.overview_row(q)
    assert source == "rollups" and row.first()["row_count"] == 60
    assert engine.overview_row(Query("S1"))[1] == "rows"
    assert engine.price_risk(q)["summary"].first()["query_rows"] == 60
    assert engine.schemas().first()["name"] == "t.csv"
    engine.compact(2)
    assert engine.count(q) == 60
    row, source = engine.overview_row(q)
    assert source == "rollups" and row.first()["row_count"] == 60  # rewritten with their parts
    before = {r["id"]: (r["month"], r["net_kg"], r["tokens"]) for r in engine.gold.collect()}
    engine.backfill()
    assert {r["id"]: (r["month"], r["net_kg"], r["tokens"]) for r in engine.gold.collect()} == before and engine.overview_row(q)[1] == "rollups"
    assert tuple(engine.stats().first()) == (1, 60, 0, 1) and engine.stored_bytes()["gold"] > 0
    assert engine.sql("SELECT count(*) AS n FROM records WHERE sender = 'S1'").first()["n"] == "20"
    with pytest.raises(ValueError):
        engine.sql("DROP TABLE records")
    assert "extra:note" not in engine.fields() and "sender" in engine.fields(1)
    engine.save_query("mine", q)
    assert engine.saved_query("mine") == q
    old = engine.gold
    engine.clear()
    assert engine.now.leaves == () and engine.gold.count() == 0 and Engine(spark, engine.where).count(q) == 0 and old.columns == engine.gold.columns
    assert engine.ingest(f"file://{tmp_path}/t.csv")["sources"][0]["inserted"] == 60


def test_saved_profiles_and_commands(spark, tmp_path, capsys):
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.save_profile("items", ["Item", "Amount"], {0: "description"})
    (tmp_path / "p.csv").write_text("Item,Amount\nbolt,10\nnut,20\n")
    assert main([engine.where, "import", f"file://{tmp_path}/p.csv"]) == 0
    assert engine.gold.orderBy("id").first()["description"] == "bolt"
    for args in (["count", "bolt"], ["search", "nut"], ["sql", "SELECT 7 AS seven"], ["stats"]):
        assert main([engine.where, *args]) == 0
    out = capsys.readouterr().out
    assert "\n1\n" in out and "nut" in out and "seven" in out


def test_schema_edits(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    (tmp_path / "p.csv").write_text("SKU,Thing,Worth\n8504,bolt,\"1,250\"\n8505,nut,20\n")
    (tmp_path / "other.csv").write_text("Supplier,Thing\nA,screw\n")
    for name in ("p", "other"):
        engine.ingest(f"file://{tmp_path}/{name}.csv")
    assert engine.fields(1)[-2:] == ["extra:Thing", "extra:Worth"]
    other = engine.now.of_schema(2)
    engine.assign(1, "Thing", "description")
    engine.assign(1, "Worth", "value")
    engine.fix(1, "EUR", "kg")
    row = engine.gold.filter("schema_id = 1").orderBy("id").first()
    assert (row["description"], row["value"], row["currency_key"], row["unit_key"], row["extra"]) == ("bolt", 1250.0, "EUR", "kg", [])
    assert engine.count(Query("bolt")) == 1 and engine.now.of_schema(2) == other  # only one schema was rewritten
    assert [(r["version"], r["header"], r["meaning"], r["currency"]) for r in engine.edits().orderBy("version").collect()] == [(1, "Thing", "description", None), (2, "Worth", "value", None), (3, None, None, "EUR")]
    # A later import of the layout obeys, and finds its duplicates as ever.
    (tmp_path / "more.csv").write_text("SKU,Thing,Worth\n8504,bolt,\"1,250\"\n8506,cog,7\n")
    assert engine.ingest(f"file://{tmp_path}/more.csv")["sources"][0]["duplicates"] == 1
    rows = engine.gold.filter("source_file = 'more.csv'").orderBy("id").collect()
    assert [(r["schema_id"], r["description"], r["value"], r["currency_key"], r["extra"], r["is_canonical"]) for r in rows] == [(1, "bolt", 1250.0, "EUR", [], False), (1, "cog", 7.0, "EUR", [], True)]
    for bad in ((1, "Thing", "nothing"), (9, "Thing", "description")):
        with pytest.raises(ValueError):
            engine.assign(*bad)


class Stop(Exception):
    pass


def test_writers_that_stop_change_nothing(spark, tmp_path, monkeypatch):
    """At each step of an import, an edit, a rewrite and clearing: readers see the store before or after, and the next try works."""
    (tmp_path / "a.csv").write_text("SKU,Amount,Thing,Currency,Weight unit\n1,10,x,USD,kg\n2,20,y,USD,kg\n")
    (tmp_path / "b.csv").write_text("SKU,Amount,Thing,Currency,Weight unit\n3,30,z,USD,kg\n")
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(f"file://{tmp_path}/a.csv")
    engine.build_rollups()

    def state():
        row, source = engine.overview_row(Query())
        return engine.count(Query()), row.first()["row_count"], source, engine.count(Query("z")), engine.edits().count()

    def stopping(own, late):
        def step(*args, **kwargs):
            if late:
                own(*args, **kwargs)
            raise Stop

        return step

    beside, end = [(token_index, "write", True), (rollups, "write_parts", True)], [(snapshots, "commit", False)]
    new, again = [(snapshots, "write_leaf", True), *beside, *end], [(snapshots, "write_leaves", True), *beside, *end]
    for act, steps, after in (
        (lambda: engine.ingest(f"file://{tmp_path}/b.csv"), new, (3, 3, "rollups", 1, 0)), (lambda: engine.assign(1, "Thing", "description"), again, (3, 3, "rollups", 1, 1)),
        (lambda: engine.compact(1), again, (3, 3, "rollups", 1, 1)), (engine.clear, end, (0, 0, "rows", 0, 0)),
    ):
        before = state()
        for module, name, late in steps:
            with monkeypatch.context() as m, pytest.raises(Stop):
                m.setattr(module, name, stopping(getattr(module, name), late))
                act()
            assert state() == before
        act()
        assert state() == after
    assert not list((tmp_path / "store/gold").glob("*/*/*"))
    # A snapshot whose writer stopped within it is passed over.
    engine.ingest(f"file://{tmp_path}/a.csv")
    (tmp_path / "store/snapshots" / f"{engine.version() + 1:012d}.json").write_text('{"leaves": [')
    assert engine.count(Query()) == 2
    engine.ingest(f"file://{tmp_path}/b.csv")
    assert engine.count(Query()) == 3


def test_the_second_of_two_writers_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SKU,Amount\n1,10\n")
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(f"file://{tmp_path}/a.csv")
    now = engine.now
    snapshots.commit(spark, engine.where, now, rolled=False)
    with pytest.raises(snapshots.ConflictError):
        snapshots.commit(spark, engine.where, now, leaves=())
    assert engine.count(Query()) == 1


def test_old_leaves_go_with_their_snapshots(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SKU,Amount\n1,10\n2,20\n")
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(f"file://{tmp_path}/a.csv")
    before = engine.gold
    for _ in range(snapshots.KEPT):
        engine.compact(1)
    assert before.count() == 2 and engine.vacuum() == 3 and engine.vacuum() == 0  # the first leaf, its tokens and its ranges
    assert engine.count(Query()) == 2


def test_a_token_is_looked_for_in_its_files_only(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    (tmp_path / "a.csv").write_text("SKU,Description\n" + "".join(f"{i},word{i} common\n" for i in range(200)))
    engine.ingest(f"file://{tmp_path}/a.csv")
    engine.compact(20)
    every = len(engine.gold.inputFiles())
    rare, common, start = (engine.rows(Query(t)) for t in ("word17", "common", "word1* common"))
    assert every > 10 and len(rare.inputFiles()) == 1 and len(common.inputFiles()) == every
    assert (rare.count(), common.count(), start.count()) == (1, 200, 111) and engine.count(Query("word17 word18")) == 0 and engine.rows(Query("nowhere")).inputFiles() == []


def test_extra_columns_are_compared_by_type_in_their_files_only(spark, tmp_path):
    """Every condition finds what comparing all rows finds, and reads no file whose ranges leave no room for a hit."""
    engine = Engine(spark, f"file://{tmp_path}/store")
    rows = []
    for part in range(4):
        own = [(f"{part}{i:02d}", f"{part * 1000 + i * 10},50", f"{i + 1:02d}.{part + 1:02d}.2024", f"Box {'abcd'[part]}{i} {'x' * 70}") for i in range(12)]
        own += [(f"{part}98", "none", "soon", ""), (f"{part}99", "", "", "")]
        rows += own
        (tmp_path / f"{part}.csv").write_text("SKU;Amount;Insured amount of cargo;Release date of cargo;Wrapping\n" + "".join(f"{k};1;{n};{d};{w}\n" for k, n, d, w in own))
        engine.ingest(f"file://{tmp_path}/{part}.csv")
    (tmp_path / "plain.csv").write_text("SKU;Amount\n7;1\n")
    engine.ingest(f"file://{tmp_path}/plain.csv")
    number = {k: float(n.replace(",", ".")) for k, n, _, _ in rows if n[:1].isdigit()}
    date = {k: f"{d[6:]}-{d[3:5]}-{d[:2]}" for k, _, d, _ in rows if d[:1].isdigit()}
    insured, release, wrapping = "extra:insured AMOUNT of cargo", "schema:1:extra:Release date of cargo", "extra:Wrapping"

    leaves = lambda frame: len({f.split("/part=")[1].split("/")[0] for f in frame.inputFiles()})

    def check(condition, want, read):
        found = engine.rows(Query(advanced=Group("and", [condition])))
        assert ({r["product_code"] for r in found.collect()}, leaves(found)) == (set(want), read), condition

    check(Condition(insured, "range", ["995", "1 020,5"]), [k for k, x in number.items() if 995 <= x <= 1020.5], 1)
    check(Condition(insured, "range", ["", "50.5"]), [k for k, x in number.items() if x <= 50.5], 1)
    check(Condition(insured, "equals", "2010.50"), [k for k, x in number.items() if x == 2010.5], 1)
    check(Condition(insured, "equals", "NONE"), [k for k, n, _, _ in rows if n == "none"], 4)
    check(Condition(insured, "range", ["9000", ""]), [], 0)
    check(Condition(release, "range", ["2024-02-05", "03.03.2024"]), [k for k, x in date.items() if "2024-02-05" <= x <= "2024-03-03"], 2)
    check(Condition(release, "any_of", ["2024.01.02", "", "2.4.2024"]), [k for k, x in date.items() if x in ("2024-01-02", "2024-04-02")], 2)
    check(Condition(wrapping, "starts_with", "box C1"), [k for k, *_, w in rows if w.startswith("Box c1")], 1)
    check(Condition(wrapping, "equals", f"box d3 {'x' * 70}"), [k for k, *_, w in rows if w.startswith("Box d3 ")], 1)
    check(Condition(wrapping, "contains", "A1"), [k for k, *_, w in rows if "a1" in w], 4)
    check(Condition("extra:Nowhere", "not_empty"), [], 0)
    every = leaves(engine.gold)
    check(Condition(wrapping, "empty"), [*[k for k, *_, w in rows if not w], "7"], every)
    check(Condition(insured, "range", ["1000", "2000"], True), [k for k, x in number.items() if not 1000 <= x <= 2000], every)
    either = Query(advanced=Group("or", [Condition(insured, "equals", "2010.50"), Condition(release, "equals", "2024-01-02")]))
    assert engine.count(either) == 2 and leaves(engine.rows(either)) == every


def test_leaves_without_range_tables_are_read_whole(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    (tmp_path / "a.csv").write_text("SKU;Amount;Insured amount of cargo\n1;1;5\n2;1;7\n")
    engine.ingest(f"file://{tmp_path}/a.csv")
    shutil.rmtree(tmp_path / "store" / snapshots.RANGES)
    assert engine.count(Query("1", advanced=Condition("extra:Insured amount of cargo", "range", ["4", "6"]))) == 1

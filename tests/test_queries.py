import pytest
from pyspark.sql import functions as F
from support import SMALL, same

from tabulark import queries
from tabulark.operators import rollups, search
from tabulark.plans.query import Condition, Group, Query, QueryError, code_prefix, filter_terms, text_terms
from tabulark.plans import compiler
from tabulark.testdata import facts

HEAVY = {"rollup_sections", "rollup_price_baselines"}
# A part of the predicates; the driver compares all of them.
CHOSEN = [n for i, n in enumerate(queries.QUERIES) if n not in HEAVY and (not n.startswith("where_") or i % 4 == 0)]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL), duck.sql(queries.SQL[name]))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_query_json_round_trip_and_limits():
    q = Query("вино", {"year": "2024"}, Group("or", [Condition("sender", "contains", "x"), Group("and", [Condition("year", "range", ["2020", None])], True)]), "occurrences")
    assert Query.from_json(q.to_json()) == q
    with pytest.raises(QueryError):
        Query.from_json("x" * 40_000)
    deep = Condition("year", "equals", "2020")
    for _ in range(20):
        deep = Group("and", [deep])
    with pytest.raises(QueryError):
        Query.from_json(Query(advanced=deep).to_json())



def test_terms():
    assert text_terms("лампа, стіл") == [("лампа", False), ("стіл", False)]
    assert text_terms("ламп*") == [("ламп", True)] and text_terms("лот 940350") == [("лот", False), ("940350", True)]
    assert filter_terms("NORDHOLM A B KAIVOKATU 7 TURKU") == ["NORDHOLM", "KAIVOKATU", "TURKU"] and filter_terms("A B") == []
    assert code_prefix("9403") == "9403" and code_prefix("2019") is None and code_prefix("9804") is None


def test_illegal_conditions(spark):
    for c in (Condition("description", "range", ["a", "b"]), Condition("value", "contains", "1"), Condition("nothing", "equals", "1"), Condition("value", "range", [None, None])):
        with pytest.raises(QueryError):
            compiler.predicate(Query(advanced=c))


def test_plans_stay_native_and_push_filters(spark):
    gold = facts(spark, SMALL)
    rows = compiler.apply(gold, Query(filters={"year": "1997", "origin_country": "CN"})).select("value")
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull" in plan and "EqualTo(year,1997)" in plan and "EqualTo(origin_country_key,CN)" in plan
    assert "Python" not in plan


def test_rollups_route_and_validate(spark):
    gold = facts(spark, SMALL)
    rolled = rollups.overview(gold)
    rollups.validate(gold, rolled)
    with pytest.raises(ValueError):
        rollups.validate(gold.filter("is_canonical"), rolled)
    assert not rollups.eligible(Query("text")) and not rollups.eligible(Query(filters={"sender": "x"})) and rollups.eligible(Query(filters={"year": "1997"}))
    assert not rollups.is_safe(rollups.chosen(rolled, Query()))  # unknown currencies make it unsafe
    known = gold.filter("currency_key = 'EUR' AND unit_key = 'kg'")
    assert rollups.is_safe(rollups.chosen(rollups.overview(known), Query())) and not rollups.is_safe(rollups.chosen(rolled, Query(filters={"year": "1800"})))


def test_parts_of_rows_add_up_to_the_whole(spark, tmp_path):
    gold = facts(spark, SMALL)
    for name in ("overview", "monthly", "currencies", "sections"):
        halves = [gold.filter(F.col("id") % 2 == i) for i in (0, 1)]
        both = {p: rollups.PARTS[p](halves[0]).unionByName(rollups.PARTS[p](halves[1])) for p in rollups.NEEDED[name]}
        keyed = lambda df: {tuple(v for v in r if not isinstance(v, float)): [v for v in r if isinstance(v, float)] for r in df.collect()}
        got, want = keyed(rollups.MERGED[name](both)), keyed(rollups.rolled(gold, name))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_record_and_batches(spark):
    gold = facts(spark, SMALL)
    q = Query(filters={"dispatch_country": "ASIA"})
    ids = [r["id"] for part in search.batches(gold, q, 500) for r in part]
    assert ids == sorted(ids) and len(ids) == compiler.apply(gold, q).count()
    assert search.record(gold, ids[0])["id"] == ids[0] and search.record(gold, -1) is None
    assert search.has_next(gold, q, limit=10) and not search.has_next(gold, q, limit=10, offset=len(ids))


def test_risk_rows_without_limit(spark, monkeypatch):
    """The registered query returns all flagged rows, whatever limit the default is."""
    asked = []
    real = queries.risk.rows_at_risk
    monkeypatch.setattr(queries.risk, "rows_at_risk", lambda rows, *a, **b: asked.append(b) or real(rows, *a, **b))
    out = queries.QUERIES["risk_rows"](spark, SMALL)
    assert asked == [{"limit": None}]
    assert "Limit" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_quartiles_of_hot_and_small_groups(spark):
    """Exact for one value, ties, negative and huge values, and a group of nearly all rows."""
    import numpy as np

    from tabulark.operators.quantiles import quartiles_by

    rng = np.random.default_rng(1)
    groups = {"hot": rng.lognormal(3, 2, 20_000), "ties": np.repeat([1.5, 2.5], [7, 2]), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "signs": np.concatenate((-rng.lognormal(0, 1, 50), np.zeros(9), rng.lognormal(0, 1, 40))), "huge": 10.0 ** rng.uniform(-200, 200, 99)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", float("nan")), ("one", float("inf")), ("one", None), ("none", None)]
    got = {r["k"]: r for r in quartiles_by(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs) and np.allclose([got[k]["p25"], got[k]["median"], got[k]["p75"]], np.quantile(vs, [0.25, 0.5, 0.75]), rtol=1e-12)
    assert {r["k"] for r in quartiles_by(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 9).collect()} == {"hot", "ties", "signs", "huge"}

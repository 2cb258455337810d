import random

import pytest
from pyspark.sql import functions as F

from tabulark.functions import dates, keys, numbers, registry, text

GROUPS = [" ", "\u00a0", "\u202f", "'", "\u2019"]
DECIMAL = {
    "7 310,45": 7310.45, "9,876.50": 9876.5, "zł 41,75": 41.75, "20917.381": 20917.381, "0.744": 0.744, "": None, "4.25E2": 425.0, "7.5E+06": 7.5e6, "3e-4": 0.0003,
    "-2,5e3": -2500.0, "8e2 kg": None, "6 100,125": 6100.125, "3.400.700": 3400700.0, "2.750": 2.75, "+5 021,25": 5021.25, "-9'876.25 t": -9876.25, "19 %": 19.0,
    ".75": 0.75, "-.25": -0.25, "2.345 678": None, "8 765.432": 8765.432, "9e999": None, "words": None, None: None,
} | {x: None for x in ("30-07", "4+4", "9.8.7", "9,8,7", "8 15 900", "5,,210", "31t7", "2e", "e9", "2e+", "2e 6", "--3")}
GROUPED = {"2.750": 2750.0, "48,200": 48200.0, "0.744": 0.744, "20917.381": 20917.381, "7 310,45": 7310.45, "zł 41,75": 41.75, "8 765.432": 8765.432, "2.75": 2.75, "-2.750": -2750.0}


def written(value: float, group: str, mark: str, digits: int) -> str:
    """A number as people write it."""
    return f"{value:,.{digits}f}".replace(",", "\0").replace(".", mark).replace("\0", group)


def check(spark, cases, fn, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], f"k string, v {kind}")
    assert df.withColumn("got", fn(F.col("k"))).filter("NOT got <=> v").collect() == []


@pytest.mark.parametrize(("cases", "grouped"), [(DECIMAL, False), (GROUPED, True)])
def test_numbers(spark, cases, grouped):
    check(spark, cases, lambda c: numbers.num_value(c, grouped), "double")


def test_numbers_in_all_spellings(spark):
    """Every mix of group and decimal marks of random numbers reads back, in both styles, and samples on the driver agree."""
    rng = random.Random(9)
    cases = {}
    for mark in ".,":
        for group in [*GROUPS, "", ".,".replace(mark, "")]:
            for digits in (1, 2, 4):
                value = round(rng.choice([-1, 1]) * rng.uniform(1000, 9e6), digits)
                cases[written(value, group, mark, digits)] = value
    for grouped in (False, True):
        check(spark, cases, lambda c, g=grouped: numbers.num_value(c, g), "double")
    assert all(numbers.reads_as_number(k) for k in cases)
    assert all(numbers.reads_as_number(k or "") == (v is not None) for k, v in DECIMAL.items() if k != "9e999")


def test_dates(spark):
    check(spark, {"27.11.2023": "2023-11-27", "4.6.2023": "2023-06-04", "2023/11/27": "2023-11-27", "2023-6-4": "2023-06-04", "9876-54-32": "9876-54-32", "коли": "коли"}, dates.normalize_date)
    check(spark, {"27.11.2023": "2023-11", "11/27/2023": "2023-11", "2023-04-77 09:30": "2023-04", "2023-17-01": "", "soon": "", None: ""}, dates.month_key)
    check(spark, {"2023-08-19": 2023, "19.08.2023": 2023, "920231": None, "": None, None: None}, dates.extract_year, "int")
    check(spark, {"45000": "2023-03-15", "45000.25": "2023-03-15 06:00:00", "24999": None, "60001": None, "x": None}, dates.excel_date)
    check(spark, {"2024-05": "2024-Q2", "2024-12": "2024-Q4", "": ""}, dates.quarter_key)


def test_keys(spark):
    check(spark, {"Китай": "CN", "chn": "CN", "U.S.A.": "US", "n/a": "", "Atlantis": "ATLANTIS", None: ""}, keys.country_key)
    check(spark, {"us dollar": "USD", "€": "EUR", "nok": "NOK", "": "__unknown__", "O'DOLLAR": "__unknown__:O'DOLLAR"}, keys.currency_key)
    check(spark, {"KGS": "kg", "т": "tonne", "": "__unknown__", "pcs": "__unknown__:pcs"}, keys.unit_key)
    assert keys.currency_hint("Value USD") == "USD" and keys.unit_hint("Вага нетто, кг") == "kg"
    assert keys.common_hint(["kg", "kg"]) == "kg" and keys.common_hint(["kg", None]) is None


def test_texts(spark):
    check(spark, {"  A\tb  C ": "a b c", None: ""}, text.text_key)
    check(spark, {" n/a ": "", "0": "", "Acme ": "Acme", None: ""}, text.label_value)
    check(spark, {"=1+1": "'=1+1", "-5": "-5", "+1,5": "+1,5", "@x": "'@x", None: ""}, text.guard_formula)
    check(spark, {"ПП «Зоря Карпат»": True, "зірка": False, None: False}, lambda c: text.contains_ci(c, "зоря"), "boolean")


def test_sql_functions_are_inlined(spark):
    registry.register_functions(spark)
    row = spark.sql("SELECT num_value('7 310,45') a, num_value_grouped('2.750') b, country_key('КИТАЙ') c, cyr_contains('АБВ', 'бв') d, pctl_num('1|x|2.5', 2) e, pctl_num('1|x', 1) f").first()
    assert tuple(row) == (7310.45, 2750.0, "CN", True, 2.5, None)
    plan = spark.sql("SELECT num_value(cast(id AS STRING)) FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan

"""Keys of countries, currencies and weight units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alphanumeric_upper, blank, text_key

UNKNOWN = "__unknown__"

#: What means "no country", as upper-cased letters and digits.
NO_COUNTRY = ["0", "00", "000", "NA", "NODATA", "ND", "НД", "НЕМАДАНИХ", "НЕТДАННЫХ"]

#: Names of countries by their key.
COUNTRIES = {
    "CN": ["CN", "CHN", "CHINA", "КИТАЙ"],
    "IE": ["IE", "IRL", "IRELAND", "ІРЛАНДІЯ", "ИРЛАНДИЯ"],
    "PL": ["PL", "POL", "POLAND", "ПОЛЬЩА", "ПОЛЬША"],
    "CZ": ["CZ", "CZE", "CZECHIA", "CZECHREPUBLIC", "ЧЕСЬКАРЕСПУБЛІКА", "ЧЕХІЯ", "ЧЕШСКАЯРЕСПУБЛИКА", "ЧЕХИЯ"],
    "DE": ["DE", "DEU", "GERMANY", "НІМЕЧЧИНА", "ГЕРМАНІЯ", "ГЕРМАНИЯ"],
    "US": ["US", "USA", "UNITEDSTATES", "UNITEDSTATESOFAMERICA", "СПОЛУЧЕНІШТАТИАМЕРИКИ", "США", "СОЕДИНЕННЫЕШТАТЫАМЕРИКИ"],
    "VN": ["VN", "VNM", "VIETNAM", "ВЄТНАМ", "ВЕТНАМ"],
    "EU": ["EU", "EUROPEANUNION", "КРАЇНИЄС", "СТРАНЫЕС"],
    "KR": ["KR", "KOR", "SOUTHKOREA", "REPUBLICOFKOREA", "ПІВДЕННАКОРЕЯ", "КОРЕЯРЕСПУБЛІКА", "ЮЖНАЯКОРЕЯ"],
    "TR": ["TR", "TUR", "TURKEY", "TURKIYE", "ТУРЕЧЧИНА", "ТУРЦІЯ", "ТУРЦИЯ"],
    "IN": ["IN", "IND", "INDIA", "ІНДІЯ", "ИНДИЯ"],
    "IT": ["IT", "ITA", "ITALY", "ІТАЛІЯ", "ИТАЛИЯ"],
    "BE": ["BE", "BEL", "BELGIUM", "БЕЛЬГІЯ", "БЕЛЬГИЯ"],
    "NL": ["NL", "NLD", "NETHERLANDS", "НІДЕРЛАНДИ", "НИДЕРЛАНДЫ"],
    "FR": ["FR", "FRA", "FRANCE", "ФРАНЦІЯ", "ФРАНЦИЯ"],
    "GB": ["GB", "UK", "GBR", "GREATBRITAIN", "UNITEDKINGDOM", "ВЕЛИКАБРИТАНІЯ", "ВЕЛИКОБРИТАНІЯ", "ВЕЛИКОБРИТАНИЯ"],
    "ES": ["ES", "ESP", "SPAIN", "ІСПАНІЯ", "ИСПАНИЯ"],
    "CH": ["CH", "CHE", "SWITZERLAND", "ШВЕЙЦАРІЯ", "ШВЕЙЦАРИЯ"],
    "AT": ["AT", "AUT", "AUSTRIA", "АВСТРІЯ", "АВСТРИЯ"],
    "FI": ["FI", "FIN", "FINLAND", "ФІНЛЯНДІЯ", "ФИНЛЯНДИЯ"],
    "LV": ["LV", "LVA", "LATVIA", "ЛАТВІЯ", "ЛАТВИЯ"],
    "LT": ["LT", "LTU", "LITHUANIA", "ЛИТВА"],
    "EE": ["EE", "EST", "ESTONIA", "ЕСТОНІЯ", "ЭСТОНИЯ"],
    "HU": ["HU", "HUN", "HUNGARY", "УГОРЩИНА", "ВЕНГРИЯ"],
    "RO": ["RO", "ROU", "ROMANIA", "РУМУНІЯ", "РУМЫНИЯ"],
    "BG": ["BG", "BGR", "BULGARIA", "БОЛГАРІЯ", "БОЛГАРИЯ"],
}

#: Spellings of currencies and weight units by their key, as text keys.
CURRENCIES = {
    "USD": ["usd", "us dollar", "us dollars", "us$"],
    "EUR": ["eur", "euro", "euros", "€"],
    "UAH": ["uah", "hryvnia", "₴"],
    "GBP": ["gbp", "pound sterling", "£"],
    "CNY": ["cny", "rmb", "yuan"],
}
UNITS = {
    "kg": ["kg", "kgs", "kilogram", "kilograms", "кг"],
    "g": ["g", "gr", "gram", "grams", "г", "гр"],
    "tonne": ["t", "ton", "tons", "tonne", "tonnes", "metric ton", "mt", "т"],
    "lb": ["lb", "lbs", "pound", "pounds"],
}
FACTORS = {"kg": 1.0, "g": 0.001, "tonne": 1000.0, "lb": 0.45359237}

#: Words of a header that name its currency or weight unit.
CURRENCY_HINTS = ["usd", "eur", "uah", "gbp", "cny", "jpy", "chf", "pln", "cad", "aud", "sek", "nok"]
UNIT_HINTS = {
    "kg": ["kg", "kgs", "кг"],
    "g": ["gram", "grams", "gm", "гр"],
    "tonne": ["ton", "tons", "tonne", "tonnes", "metricton", "mt"],
    "lb": ["lb", "lbs", "pound", "pounds"],
}


def _lookup(key: Column, names: dict[str, list[str]]) -> Column:
    """A literal map: one hash probe a row, whatever the number of names."""
    pairs = [F.lit(x) for to, own in names.items() for name in own for x in (name, to)]
    return F.try_element_at(F.create_map(*pairs), key)


def country_key(c: Column) -> Column:
    key = alphanumeric_upper(c)
    known = _lookup(key, COUNTRIES)
    return F.when(key.isin(NO_COUNTRY), F.lit("")).otherwise(F.coalesce(known, key))


def currency_key(c: Column) -> Column:
    key = text_key(c)
    return F.coalesce(
        _lookup(key, CURRENCIES),
        F.when(key == "", F.lit(UNKNOWN)).when(F.regexp_like(key, F.lit("^[a-z]{3}$")), F.upper(key)).otherwise(F.concat(F.lit(f"{UNKNOWN}:"), F.upper(key))),
    )


def unit_key(c: Column) -> Column:
    key = text_key(c)
    return F.coalesce(_lookup(key, UNITS), F.when(key == "", F.lit(UNKNOWN)).otherwise(F.concat(F.lit(f"{UNKNOWN}:"), key)))


def unit_factor(unit: Column) -> Column:
    """Kilograms in a unit key; null for unknown ones."""
    out = F.lit(None).cast("double")
    for name, factor in FACTORS.items():
        out = F.when(unit == name, F.lit(factor)).otherwise(out)
    return out


def is_known(key: Column) -> Column:
    return (blank(key) != "") & ~F.startswith(blank(key), F.lit(UNKNOWN))


def _words(header: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", header.lower()) if w]


def currency_hint(header: str) -> str | None:
    return next((w.upper() for w in _words(header) if w in CURRENCY_HINTS), None)


def unit_hint(header: str) -> str | None:
    return next((unit for unit, names in UNIT_HINTS.items() if set(names) & set(_words(header))), None)


def common_hint(hints: list[str | None]) -> str | None:
    """The hint that all headers give, if they do."""
    return hints[0] if hints and len(set(hints)) == 1 else None

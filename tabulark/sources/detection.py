"""Finding the header row of a table and the meanings of its columns, from its first rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

from ..functions.numbers import reads_as_number
from ..schema import SourceColumn, TableShape

HEADER_ROWS, SAMPLE_ROWS = 50, 8
MOST_COLUMNS = 16_384

#: Names of columns by meaning, in English, Ukrainian and Russian. Weak ones also need fitting samples.
ALIASES = {
    "date": ["date", "order date", "document date", "declaration date", "clearance date", "invoice date", "дата", "дата документа", "дата декларації", "дата оформлення", "дата мд"],
    "declaration_number": ["declaration", "declaration no", "declaration number", "document no", "document number", "invoice no", "invoice number", "номер декларації", "номер декларации", "номер мд", "номер документа"],
    "company_code": ["company code", "company id", "recipient code", "buyer code", "importer code", "edrpou", "єдрпоу", "едрпоу", "код єдрпоу", "код компанії", "код компании"],
    "sender": ["sender", "supplier", "exporter", "shipper", "seller", "відправник", "отправитель"],
    "recipient": ["recipient", "receiver", "buyer", "customer", "importer", "consignee", "одержувач", "отримувач", "покупець", "получатель", "покупатель"],
    "product_code": ["sku", "article", "article no", "product code", "item code", "goods code", "commodity code", "hs", "hs code", "uktzed", "tnved", "артикул", "артикул товару", "код товару", "код товара", "код уктзед"],
    "description": ["description", "product description", "product name", "item description", "item name", "goods description", "goods name", "опис", "опис товару", "опис позиції", "назва товару", "описание товара"],
    "trademark": ["brand", "brand name", "trademark", "trade mark", "бренд", "торгова марка", "торговая марка"],
    "country": ["country", "країна", "страна"],
    "origin_country": ["origin", "origin country", "country of origin", "країна походження", "страна происхождения"],
    "dispatch_country": ["dispatch country", "country of dispatch", "ship from", "shipping country", "departure country", "країна відправлення", "страна отправления"],
    "trade_country": ["trade country", "trading country", "seller country", "торгуюча країна", "країна торгівлі", "торгующая страна"],
    "quantity": ["quantity", "qty", "count", "units", "кількість", "количество"],
    "net_weight": ["net kg", "net weight", "net weight kg", "weight net", "вага нетто", "нетто кг", "вес нетто"],
    "gross_weight": ["gross kg", "gross weight", "gross weight kg", "weight gross", "вага брутто", "брутто кг", "вес брутто"],
    "value": ["value", "value usd", "amount", "amount usd", "total value", "total amount", "invoice value", "customs value", "сума", "сума рахунку", "вартість", "фв вал контр", "сумма", "стоимость"],
    "currency": ["currency", "currency code", "ccy", "валюта", "код валюти", "код валюты"],
    "weight_unit": ["weight unit", "net weight unit", "mass unit", "weight uom", "одиниця ваги", "единица веса"],
    "rfv": ["рфв дол кг", "rfv usd kg"],
}
WEAK = {"country", "quantity", "value"}
#: Long starts of headers that say the meaning whatever follows.
STARTS = {
    "номердекларац": "declaration_number", "declarationnumber": "declaration_number", "declarationno": "declaration_number",
    "датадокумент": "date", "датаоформлен": "date", "documentdate": "date",
    "кодтовар": "product_code", "productcode": "product_code", "commoditycode": "product_code",
    "опистовар": "description", "описаниетовар": "description", "productdescription": "description", "goodsdescription": "description",
    "фактурнаварт": "value", "фактурнаястоим": "value", "invoicevalue": "value",
}
_NAME_WORDS = ("name", "назва", "наименование", "название")


def plain(header: str) -> str:
    return "".join(c for c in header.lstrip("﻿").lower() if c.isalnum())


_MEANING = {plain(a): meaning for meaning, names in ALIASES.items() for a in names}


def clean(cell: str | None) -> str:
    return " ".join((cell or "").lstrip("﻿").split())


def meaning_of(header: str) -> str | None:
    key = plain(header)
    if key in _MEANING:
        return _MEANING[key]
    for word in _NAME_WORDS:  # "supplier name", "назва покупця"
        rest = key.removeprefix(word).removesuffix(word)
        if rest != key and _MEANING.get(rest) in ("sender", "recipient"):
            return _MEANING[rest]
    return next((m for start, m in STARTS.items() if key.startswith(start)), None)


def is_number(cell: str) -> bool:
    """A bare number, which a header seldom is: digits with spaces, one point or comma, and perhaps an exponent."""
    bare = re.sub("[ \u00a0\u202f]", "", cell.strip()).replace(",", ".")
    return bool(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", bare))


def is_label(cell: str) -> bool:
    """Up to 120 characters with letters, at least as many as digits."""
    text = clean(cell)
    letters = sum(c.isalpha() for c in text)
    return 0 < letters >= sum(c in "0123456789" for c in text) and len(text) <= 120


def width(row: list[str]) -> int:
    return max((i + 1 for i, c in enumerate(row) if clean(c)), default=0)


#: Points of a header row for each filled cell, label, known meaning and different name, for each row after it of like width, each column
#: that turns from a label to values, and each bare number.
HEADER_POINTS = {"filled": 20, "labels": 6, "meanings": 12, "different": 2, "steady": 3, "turns": 2, "numbers": -10}


def header_score(rows: list[list[str]], at: int) -> int | None:
    """How much a row looks like the header of the rows after it; None for empty rows."""
    row = [clean(c) for c in rows[at]]
    filled = [c for c in row if c]
    if not filled:
        return None
    after = rows[at + 1 : at + 1 + SAMPLE_ROWS]
    own = width(row)
    steady = sum(0 < width(r) and abs(width(r) - own) <= max(own // 5, 1) for r in after)
    turns = sum(is_label(row[i]) and any(i < len(r) and not is_label(r[i]) for r in after) for i in range(own))
    found = {
        "filled": len(filled), "labels": sum(map(is_label, filled)), "meanings": sum(meaning_of(c) is not None for c in filled), "different": len({plain(c) for c in filled} - {""}),
        "steady": steady, "turns": turns, "numbers": sum(map(is_number, filled)),
    }
    return sum(n * HEADER_POINTS[what] for what, n in found.items())


@dataclass
class DetectedTable:
    header_row: int
    headers: list[str]
    meanings: dict[int, str]
    joined: list[int]  # columns that make the declaration number together

    def shape(self, schema_id: int = 1, fixed_currency: str | None = None, fixed_weight_unit: str | None = None) -> TableShape:
        columns = [SourceColumn(f"c{i}", h, i, role(h), self.meanings.get(i)) for i, h in enumerate(self.headers)]
        return TableShape(columns, fixed_currency, fixed_weight_unit, schema_id)


#: Parts of headers that tell a column's role, the first that fits.
ROLE_WORDS = (
    ("date", ("date", "дата")), ("year", ("year", "рік", "год")), ("country", ("country", "країна", "страна")), ("money", ("price", "amount", "value", "ціна", "сума", "цена", "сумма")),
    ("weight", ("weight", "вага", "вес", "нетто", "брутто")), ("number", ("quantity", "qty", "count", "кількість", "количество")), ("code", ("code", "sku", "код")), ("identifier", ("number", "номер", "id")),
)


def role(header: str) -> str:
    text = header.lower()
    return next((name for name, words in ROLE_WORDS if any(w in text for w in words)), "text")


def display_headers(headers: list[str]) -> list[str]:
    """Blank headers are numbered by place, repeated ones by occurrence."""
    seen: Counter[str] = Counter()
    out = []
    for i, h in enumerate(headers):
        base = clean(h) or f"Column {i + 1}"
        seen[plain(base)] += 1
        out.append(base if seen[plain(base)] == 1 else f"{base} ({seen[plain(base)]})")
    return out


def _share(values: list[str], fits) -> float:
    return sum(map(fits, values)) / len(values) if values else 0.0


def _meanings(headers: list[str], samples: list[list[str]]) -> tuple[dict[int, str], list[int]]:
    values = lambda i: [clean(r[i]) for r in samples if i < len(r) and clean(r[i])]
    found = {}
    for i, h in enumerate(headers):
        meaning = meaning_of(h)
        if meaning in WEAK:
            fits = reads_as_number if meaning != "country" else lambda v: any(c.isalpha() for c in v) and len(v) <= 60
            if _share(values(i), fits) < 0.7:
                continue
        if meaning:
            found[i] = meaning
    by_meaning = lambda m: [i for i, x in found.items() if x == m]
    codes = []
    for party in ("recipient", "sender"):
        columns = by_meaning(party)
        if len(columns) < 2:
            continue
        code_like = [i for i in columns if _share(values(i), lambda v: bool(re.fullmatch(r"[0-9]{5,12}", v))) >= 0.8]
        names = [i for i in columns if _share(values(i), lambda v: sum(c.isalpha() for c in v) >= 3) >= 0.7]
        keep = names[0] if names else next((i for i in columns if i not in code_like), columns[0])
        for i in columns:
            if i != keep:
                del found[i]
        if len(code_like) == 1 and len(names) == 1:
            codes.append(code_like[0])
    if len(codes) == 1 and not by_meaning("company_code"):
        found[codes[0]] = "company_code"
    joined = by_meaning("declaration_number")
    for meaning in set(found.values()) - {"declaration_number", "recipient", "sender", "company_code"}:
        columns = by_meaning(meaning)
        if len(columns) > 1:
            filled = {i: len(values(i)) for i in columns}
            best = [i for i in columns if filled[i] == max(filled.values()) > 0]
            for i in columns:
                if best != [i]:
                    del found[i]
    return found, joined


def detect_table(rows: list[list[str]]) -> DetectedTable | None:
    """The best header among the first rows (the earliest of equals), its columns and their meanings."""
    scores = {i: s for i in range(min(len(rows), HEADER_ROWS)) if (s := header_score(rows, i)) is not None}
    if not scores:
        return None
    at = max(scores, key=lambda i: (scores[i], -i))
    wide = max(width(r) for r in rows[at : at + SAMPLE_ROWS + 1])
    if wide > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    headers = [rows[at][i] if i < len(rows[at]) else "" for i in range(wide)]
    meanings, joined = _meanings(headers, rows[at + 1 : at + 1 + SAMPLE_ROWS])
    return DetectedTable(at, display_headers(headers), meanings, joined)


def override(table: DetectedTable, choices: dict[int, str | None]) -> DetectedTable:
    """Meanings set by hand; two columns for one meaning are an error, except for the declaration number."""
    meanings = {i: m for i, m in {**table.meanings, **choices}.items() if m}
    twice = [m for m, n in Counter(meanings.values()).items() if n > 1 and m != "declaration_number"]
    if twice and set(twice) & set(choices.values()):
        raise ValueError(f"several columns for {sorted(twice)}")
    return DetectedTable(table.header_row, table.headers, meanings, [i for i, m in meanings.items() if m == "declaration_number"])


def signature(headers: list[str]) -> str:
    """Identity of an ordered layout, by which saved mappings are found again."""
    return hashlib.sha256("\x1e".join(f"{plain(h)}\x1f{role(h)}" for h in headers).encode()).hexdigest()

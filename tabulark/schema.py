"""Meanings of columns, and the columns of raw (bronze) and derived (gold) tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Meanings a source column can have, with the kind of field each makes.
SEMANTICS = {
    "date": "date",
    "declaration_number": "code",
    "company_code": "code",
    "sender": "text",
    "recipient": "text",
    "product_code": "code",
    "description": "text",
    "trademark": "text",
    "country": "country",
    "origin_country": "country",
    "dispatch_country": "country",
    "trade_country": "country",
    "quantity": "number",
    "net_weight": "number",
    "gross_weight": "number",
    "value": "number",
    "currency": "code",
    "weight_unit": "code",
}
#: Price columns of the customs profile and what each is a price of.
PRICES = {"rfv": "net", "rmv_net": "net", "rmv_extra": "quantity", "rmv_gross": "gross", "min_base": "net"}

EXTRA = T.ArrayType(T.StructType([T.StructField("header", T.StringType()), T.StructField("value", T.StringType())]))

LABELS = ("declaration_number", "company_code", "sender", "recipient", "product_code", "description", "trademark")
COUNTRIES = ("origin_country", "dispatch_country", "trade_country")
#: Texts of a row that full-text search looks in, besides its extra columns.
SEARCHED = ("declaration_number", "date", "company_code", "sender", "recipient", "product_code", "description", "trademark", *COUNTRIES)
#: Numbers that read a lone separator before three digits as thousands.
GROUPED_NUMBERS = ("value", "quantity")


@dataclass(frozen=True)
class SourceColumn:
    """A column of an ordered source layout."""

    id: str
    header: str
    index: int
    role: str = "text"
    semantic: str | None = None


@dataclass
class TableShape:
    """One source layout with fixed meanings of the whole file."""

    columns: list[SourceColumn] = field(default_factory=list)
    fixed_currency: str | None = None
    fixed_weight_unit: str | None = None
    schema_id: int = 1

    def sources(self, semantic: str) -> list[SourceColumn]:
        return [c for c in self.columns if c.semantic == semantic]

    def headers(self, semantic: str) -> list[str]:
        return [c.header for c in self.sources(semantic)]

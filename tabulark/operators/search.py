"""Search pages, counts, record cards and keyset batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text
from ..plans import compiler
from ..plans.query import Query, QueryError
from ..schema import PRICES, SEMANTICS

MOST_PAGE, PAGE = 200, 50
NUMBERS = ("value", "quantity", "net", "gross", *PRICES)
#: Columns shown by default, and preset selections.
FIELDS = tuple(s for s in SEMANTICS if s not in ("value", "quantity", "net_weight", "gross_weight")) + NUMBERS + ("year", "source_file")
PRESETS = {
    "basic": ("date", "declaration_number", "sender", "recipient", "product_code", "description", "value"),
    "companies": ("date", "company_code", "sender", "recipient", "trademark", "value"),
    "goods": ("product_code", "description", "trademark", "quantity", "net", "gross"),
    "prices": ("product_code", "value", "net", *PRICES),
    "logistics": ("date", "origin_country", "dispatch_country", "trade_country", "net", "gross"),
}

#: Fields by what they are shown under.
GROUPS = {
    "document": ("date", "declaration_number", "year"),
    "companies": ("company_code", "sender", "recipient"),
    "goods": ("product_code", "description", "trademark"),
    "countries": ("country", "origin_country", "dispatch_country", "trade_country"),
    "amounts": ("quantity", "net", "gross", "weight_unit"),
    "prices": ("value", "currency", *PRICES),
    "source": ("source_file",),
}


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


def field_column(name: str) -> Column:
    if name.startswith("extra:"):
        return text.extra_value(F.col("extra"), name[6:]).alias(name[6:])
    if name not in FIELDS:
        raise QueryError(f"unknown field: {name}")
    return F.col(name)


def ordering(q: Query, sort: Sort | None, strict: bool = False) -> list[Column]:
    """Newest first: by id for an empty query, else by date text; or a field, typed or without case, then id."""
    if sort is not None:
        known = sort.field in FIELDS or sort.field.startswith("extra:")
        if not known and strict:
            raise QueryError(f"unknown sort field: {sort.field}")
        if known:
            c = field_column(sort.field)
            c = c if sort.field in (*NUMBERS, "year", "date") else F.lower(c)
            return [c.desc() if sort.descending else c.asc(), F.col("id").desc()]
    if not q.text.strip() and not any(v.strip() for v in q.filters.values()):
        return [F.col("id").desc()]
    return [F.col("date").desc(), F.col("id").desc()]


def page(gold: DataFrame, q: Query, fields: Sequence[str] = FIELDS, sort: Sort | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Rows of one page; Spark keeps offset + limit rows a task at most."""
    limit = max(1, min(limit, MOST_PAGE))
    rows = compiler.apply(gold, q).orderBy(*ordering(q, sort)).offset(offset).limit(limit)
    return rows.select("id", *[field_column(f) for f in fields])


def has_next(gold: DataFrame, q: Query, limit: int = PAGE, offset: int = 0) -> bool:
    return not compiler.apply(gold, q).select("id").orderBy(F.col("id").desc()).offset(offset + limit).limit(1).isEmpty()


def count(gold: DataFrame, q: Query) -> DataFrame:
    return compiler.apply(gold, q).agg(F.count("*").alias("rows"))


def record(gold: DataFrame, id_: int) -> Row | None:
    """All fields and extra values of one record."""
    return gold.filter(F.col("id") == id_).select("id", *FIELDS, "extra").first()


def batches(gold: DataFrame, q: Query, size: int = 10_000) -> Iterator[list[Row]]:
    """Keyset batches by id, each a bounded query."""
    last = None
    while True:
        rows = compiler.apply(gold, q) if last is None else compiler.apply(gold, q).filter(F.col("id") > last)
        part = rows.orderBy("id").limit(size).select("id", *FIELDS).collect()  # `size` rows
        if not part:
            return
        yield part
        last = part[-1]["id"]


def extra_headers(gold: DataFrame) -> DataFrame:
    """The distinct headers of extra columns by their normal form, first spelling (by text) kept."""
    headers = gold.select(F.explode("extra.header").alias("header"))
    return headers.groupBy(text.text_key(F.col("header")).alias("key")).agg(F.min("header").alias("header"))

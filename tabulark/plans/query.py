"""Queries: free text, filters, a nested boolean expression and a record scope; their JSON form."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from typing import Any

#: Limits of a query in JSON.
MOST_CHARS, MOST_DEPTH, MOST_NODES = 32_768, 12, 256
#: Limits of full-text terms.
MOST_TERMS, MOST_FILTER_TERMS = 32, 8

FILTERS = ("year", "product_code", "company_code", "trademark", "description", "sender", "recipient", "origin_country", "dispatch_country", "trade_country")
OPERATORS = {
    "text": {"contains", "equals", "starts_with", "any_of", "empty", "not_empty"},
    "code": {"starts_with", "equals", "any_of", "empty", "not_empty"},
    "country": {"equals", "any_of", "empty", "not_empty"},
    "number": {"equals", "range", "empty", "not_empty"},
    "date": {"equals", "range", "empty", "not_empty"},
    "year": {"equals", "range", "empty", "not_empty"},
}


class QueryError(ValueError):
    """A query that can't be run as it is written."""


@dataclass
class Condition:
    """field: a meaning, `year`, `source_file`, `extra:HEADER`, or `schema:ID:FIELD` for one source only."""

    field: str
    op: str
    value: Any = None
    negated: bool = False

    def is_empty(self) -> bool:
        if self.op in ("empty", "not_empty"):
            return False
        if self.op == "range":
            return not any((x or "").strip() for x in self.value or ())
        if self.op == "any_of":
            return not any((x or "").strip() for x in self.value or ())
        return not (self.value or "").strip()


@dataclass
class Group:
    op: str = "and"
    children: list[Group | Condition] = field(default_factory=list)
    negated: bool = False


@dataclass
class Query:
    text: str = ""
    filters: dict[str, str] = field(default_factory=dict)
    advanced: Group | Condition | None = None
    scope: str = "canonical"
    snapshot: int | None = None

    def __post_init__(self) -> None:
        if unknown := set(self.filters) - set(FILTERS):
            raise QueryError(f"unknown filters: {sorted(unknown)}")
        if self.scope not in ("canonical", "occurrences"):
            raise QueryError(f"unknown scope: {self.scope}")

    def to_json(self) -> str:
        def plain(x):
            if isinstance(x, Group):
                return {"group": x.op, "negated": x.negated, "children": [plain(c) for c in x.children]}
            return asdict(x) if x is not None else None

        return json.dumps({"text": self.text, "filters": self.filters, "advanced": plain(self.advanced), "scope": self.scope, "snapshot": self.snapshot}, ensure_ascii=False)

    @classmethod
    def from_json(cls, source: str) -> Query:
        if len(source) > MOST_CHARS:
            raise QueryError("the query is too long")
        nodes = 0

        def build(x, depth: int):
            nonlocal nodes
            nodes += 1
            if depth > MOST_DEPTH or nodes > MOST_NODES:
                raise QueryError("the query is nested too deeply or has too many conditions")
            if x is None:
                return None
            if "group" in x:
                return Group(x["group"], [build(c, depth + 1) for c in x["children"]], bool(x.get("negated")))
            return Condition(x["field"], x["op"], x.get("value"), bool(x.get("negated")))

        raw = json.loads(source)
        return cls(raw.get("text", ""), raw.get("filters", {}), build(raw.get("advanced"), 0), raw.get("scope", "canonical"), raw.get("snapshot"))

    def with_month(self, month: str) -> Query:
        """Drill down into a month: its days as a text range, as dates are compared as texts."""
        from calendar import monthrange

        last = monthrange(int(month[:4]), int(month[5:7]))[1]
        days = Condition("date", "range", [f"{month}-01", f"{month}-{last:02d}"])
        parts = [self.advanced] if self.advanced is not None else []
        return Query(self.text, dict(self.filters), Group("and", [*parts, days]), self.scope, self.snapshot)

    def with_filter(self, name: str, value: str) -> Query:
        """Drill down into a group row."""
        return Query(self.text, {**self.filters, name: value}, self.advanced, self.scope, self.snapshot)


def text_terms(text: str) -> list[tuple[str, bool]]:
    """(term, prefix) of free text: runs of letters and digits; `word*` and numbers of four digits or more are prefixes."""
    out = [(m[1], bool(m[2]) or (m[1].isascii() and m[1].isdigit() and len(m[1]) >= 4)) for m in re.finditer(r"([^\W_]+)(\*?)", text)]
    return out[:MOST_TERMS]


def filter_terms(value: str) -> list[str]:
    """Prefix terms of a filter's value: its words of three characters or more."""
    return [w for w in re.findall(r"[^\W_]+", value) if len(w) >= 3][:MOST_FILTER_TERMS]


def plain_terms(text: str) -> list[str]:
    """Terms that rows without a text index are searched for as substrings."""
    words = (w.strip("*'-").lower() for w in re.split(r"[^\w'-]|_", text))
    return [w for w in words if len(w) >= 2][:MOST_TERMS]


def code_prefix(text: str) -> str | None:
    """The text if it can be the start of a product code: 4 to 10 digits, chapter 01 to 97, and no year."""
    text = text.strip()
    if not re.fullmatch(r"[0-9]{4,10}", text) or not 1 <= int(text[:2]) <= 97 or (len(text) == 4 and text.startswith("20")):
        return None
    return text

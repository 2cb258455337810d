"""Queries as one predicate over gold rows. Filters on stored keys reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, keys, numbers, text
from ..functions.numbers import reads_as_number
from ..schema import COUNTRIES, GROUPED_NUMBERS, PRICES, SEMANTICS
from ..sources.detection import role
from ..sources.token_index import RANGE_CHARS
from .query import OPERATORS, Condition, Group, Query, QueryError, code_prefix, filter_terms, plain_terms, text_terms

#: Roles of headers whose extra columns are compared as numbers.
_NUMBER_ROLES = ("number", "money", "weight")
_NUMBER_COLUMNS = {"net_weight": "net", "gross_weight": "gross", "value": "value", "quantity": "quantity", **{p: p for p in PRICES}}



def has_term(term: str, prefix: bool = False) -> Column:
    """A row's text has the token, or one that starts so."""
    folded = text.folded(F.lit(term))
    if not prefix:
        return F.array_contains("tokens", folded)
    return F.exists("tokens", lambda t: F.startswith(t, folded))


class FieldExpr:
    """What a condition's field means: its text, its kind, and stored columns for numbers and countries."""

    def __init__(self, name: str):
        self.guard, self.typed = None, None
        if name.startswith("schema:"):
            _, schema, name = name.split(":", 2)
            self.guard = F.col("schema_id") == int(schema)
        self.number = self.country = None
        if name.startswith("extra:"):
            self.text, self.kind, self.grouped = text.extra_value(F.col("extra"), name[6:]), "text", False
            self.typed = extra_kind(name[6:])
        elif name == "source_file":
            self.text, self.kind, self.grouped = F.col(name), "text", False
        elif name == "year":
            self.text, self.kind, self.grouped = F.col("year").cast("string"), "year", False
        elif name in _NUMBER_COLUMNS:
            self.number, self.kind, self.grouped = F.col(_NUMBER_COLUMNS[name]), "number", name in GROUPED_NUMBERS
            self.text = self.number.cast("string")
        elif name in SEMANTICS:
            self.text, self.kind, self.grouped = F.col(name), SEMANTICS[name], False
            self.country = F.col(f"{name}_key") if SEMANTICS[name] == "country" else None
        else:
            raise QueryError(f"unknown field: {name}")
        if self.guard is not None:
            self.text = F.when(self.guard, self.text)
            self.number = F.when(self.guard, self.number) if self.number is not None else None
            self.country = F.when(self.guard, self.country) if self.country is not None else None

    def bound(self, value: str) -> Column:
        """A number of a condition, read in the style of the stored values."""
        return numbers.num_value(F.lit(value), self.grouped)

    def year(self, value: str) -> int:
        digits = "".join(c for c in value if c.isascii() and c.isdigit())
        if len(digits) != 4:
            raise QueryError("a year has four digits")
        return int(digits)

    def equals(self, value: str) -> Column:
        if self.typed == "number" and reads_as_number(value):
            return numbers.num_value(self.text) == self.bound(value)
        if self.typed == "date":
            wanted = dates.date_value(F.lit(value))
            return F.when(wanted.isNotNull(), dates.date_value(self.text) == wanted).otherwise(text.text_key(self.text) == text.text_key(F.lit(value)))
        if self.kind == "text":
            return text.text_key(self.text) == text.text_key(F.lit(value))
        if self.kind in ("code", "date"):
            return text.trimmed(text.blank(self.text)) == value
        if self.kind == "country":
            return self.country == keys.country_key(F.lit(value))
        if self.kind == "number":
            return self.number == self.bound(_number(value, self.grouped))
        return F.col("year") == self.year(value)

    def between(self, low: str, high: str) -> Column:
        parts = []
        for bound, above in ((low, True), (high, False)):
            if not bound:
                continue
            if self.typed == "number":
                left, right = numbers.num_value(self.text), self.bound(_number(bound, self.grouped))
            elif self.typed == "date":  # cells without a date are in no range
                left, right = dates.date_value(self.text), dates.date_text(F.lit(bound))
            elif self.kind == "number":
                left, right = self.number, self.bound(_number(bound, self.grouped))
            elif self.kind == "year":
                left, right = F.col("year"), F.lit(self.year(bound))
            else:  # dates are compared as texts
                left, right = text.trimmed(text.blank(self.text)), F.lit(bound)
            parts.append(left >= right if above else left <= right)
        return reduce(lambda a, b: a & b, parts)


def extra_kind(header: str) -> str:
    """What an extra column's cells are compared as, besides as texts: numbers or dates if its header says so."""
    found = role(header)
    return "number" if found in _NUMBER_ROLES else "date" if found == "date" else "text"


def _number(value: str, grouped: bool) -> str:
    if not any(c.isdigit() for c in value):
        raise QueryError("a number condition needs a number")
    return value


def condition(c: Condition) -> Column | None:
    if c.is_empty():
        if c.op == "range":
            raise QueryError("a range needs a bound")
        return None
    field = FieldExpr(c.field)
    if c.op not in OPERATORS[field.kind] and not (c.op == "range" and field.typed in ("number", "date")):
        raise QueryError(f"{c.op} is not valid for {field.kind} fields")
    strip = lambda v: (v or "").strip()
    if c.op == "contains":
        out = text.contains_ci(field.text, strip(c.value))
    elif c.op == "equals":
        out = field.equals(strip(c.value))
    elif c.op == "starts_with":
        out = F.startswith(text.blank(field.text), F.lit(strip(c.value))) if field.kind == "code" else F.startswith(text.text_key(field.text), text.text_key(F.lit(strip(c.value))))
    elif c.op == "any_of":
        out = reduce(lambda a, b: a | b, [field.equals(strip(v)) for v in c.value if strip(v)])
    elif c.op == "range":
        out = field.between(strip(c.value[0]), strip(c.value[1]))
    else:
        out = text.trimmed(text.blank(field.text)) == ""
        out = out if c.op == "empty" else ~out
    return ~out if c.negated else out


def expression(e: Group | Condition | None) -> Column | None:
    """Nested groups; empty children are skipped, an empty group filters nothing."""
    if e is None:
        return None
    if isinstance(e, Condition):
        return condition(e)
    parts = [p for p in map(expression, e.children) if p is not None]
    if not parts:
        return None
    if e.op not in ("and", "or"):
        raise QueryError(f"unknown group operator: {e.op}")
    out = reduce((lambda a, b: a & b) if e.op == "and" else (lambda a, b: a | b), parts)
    return ~out if e.negated else out


def needed_terms(q: Query) -> list[tuple[str, bool]]:
    """(token, prefix): what a row's tokens must have each of to be a hit, whatever the rest of the query asks."""
    out = [] if code_prefix(q.text) else list(text_terms(q.text))
    for name in ("description", "sender", "recipient"):
        out += [(t, True) for t in filter_terms(q.filters.get(name, "").strip())]
    return out


def needed_ranges(q: Query) -> list[Column]:
    """What a file's range table must have a row of for each, or none of the file's rows is a hit: the conditions on extra columns that all hits fulfil."""
    conditions: list[Condition] = []

    def visit(e: Group | Condition | None) -> None:
        if isinstance(e, Group) and e.op == "and" and not e.negated:
            for child in e.children:
                visit(child)
        elif isinstance(e, Condition) and not e.negated and not e.is_empty() and e.op != "empty":
            conditions.append(e)

    visit(q.advanced)
    out = []
    for c in conditions:
        name = c.field.split(":", 2)[2] if c.field.startswith("schema:") else c.field
        if name.startswith("extra:"):
            out.append((F.col("key") == text.text_key(F.lit(name[6:]))) & _in_range(c, extra_kind(name[6:])))
    return out


def _in_range(c: Condition, kind: str) -> Column:
    """Whether a file's least and greatest values of an extra column leave room for a hit."""
    start = lambda v: F.left(v, F.lit(RANGE_CHARS))
    number, date, plain = (lambda v: numbers.num_value(F.lit(v))), (lambda v: start(dates.date_text(F.lit(v)))), (lambda v: start(text.text_key(F.lit(v))))

    def meets(low: str, high: str, suffix: str, value) -> Column:
        bounds = [F.col(f"high{suffix}") >= value(low)] if low else []
        bounds += [F.col(f"low{suffix}") <= value(high)] if high else []
        return reduce(lambda a, b: a & b, bounds)

    def same(v: str) -> Column:
        if kind == "number" and reads_as_number(v):
            return meets(v, v, "", number)
        same_text = meets(v, v, "_text", plain)
        return F.when(dates.date_value(F.lit(v)).isNotNull(), meets(v, v, "_date", date)).otherwise(same_text) if kind == "date" else same_text

    strip = lambda v: (v or "").strip()
    if c.op == "equals":
        return same(strip(c.value))
    if c.op == "any_of":
        return reduce(lambda a, b: a | b, [same(strip(v)) for v in c.value if strip(v)])
    if c.op == "range":
        low, high = strip(c.value[0]), strip(c.value[1])
        return meets(low, high, "", number) if kind == "number" else meets(low, high, "_date", date)
    if c.op == "starts_with":
        head = plain(strip(c.value))
        return (F.col("high_text") >= head) & (F.left("low_text", F.length(head)) <= head)
    return F.lit(True)


def predicate(q: Query, substring: bool = False) -> list[Column]:
    """The clauses of a query, to be and-ed; substring: free text as on rows without an index."""
    out: list[Column] = []
    if q.scope == "canonical":
        out.append(F.col("is_canonical"))
    if q.snapshot is not None:
        out.append(F.col("id") <= q.snapshot)
    value = {k: v.strip() for k, v in q.filters.items()}
    get = lambda name: value.get(name, "")
    if year := get("year"):
        digits = "".join(c for c in year if c.isascii() and c.isdigit())
        if len(digits) == 4:
            out.append(F.col("year") == int(digits))
    if code := code_prefix(q.text):
        out.append(F.startswith("product_code", F.lit(code)) | (text.text_key(F.col("company_code")) == code))
    elif substring:
        everything = F.concat_ws(" ", *[F.col(s) for s in ("declaration_number", "date", "company_code", "sender", "recipient", "product_code", "description", "trademark", *COUNTRIES)], text.extra_values_text(F.col("extra")))
        out += [text.contains_ci(everything, t) for t in plain_terms(q.text)]
    else:
        out += [has_term(t, p) for t, p in text_terms(q.text)]
    if get("product_code"):
        out.append(F.startswith("product_code", F.lit(get("product_code"))))
    if get("company_code"):
        out.append(text.text_key(F.col("company_code")) == text.text_key(F.lit(get("company_code"))))
    if get("trademark"):
        out.append(text.text_key(F.col("trademark")) == text.text_key(F.lit(get("trademark"))))
    for name in ("description", "sender", "recipient"):
        if get(name):
            out.append(text.contains_ci(F.col(name), get(name)))
            out += [has_term(t, True) for t in filter_terms(get(name))]
    for name in COUNTRIES:
        if get(name):
            out.append(F.col(f"{name}_key") == keys.country_key(F.lit(get(name))))
    if (advanced := expression(q.advanced)) is not None:
        out.append(advanced)
    return out


def apply(gold: DataFrame, q: Query, substring: bool = False) -> DataFrame:
    """The rows of a query; separate filters, so each that can be is pushed to the scan."""
    for clause in predicate(q, substring):
        gold = gold.filter(clause)
    return gold

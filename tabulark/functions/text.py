"""Text expressions: normal keys, labels, tokens, extra columns. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mean "no value", as upper-cased letters and digits.
PLACEHOLDER_LABELS = [
    "0", "00", "000", "0000", "NA", "NА", "ND", "NULL", "NONE", "NODATA", "UNKNOWN",
    "НД", "НЕМАДАНИХ", "НЕТДАННЫХ", "НЕВІДОМО", "НЕИЗВЕСТНО",
]

#: The letters and digits they begin with.
PLACEHOLDER_STARTS = "".join(sorted({x for w in PLACEHOLDER_LABELS for x in (w[0], w[0].lower())}))

#: Latin letters with marks that full-text search takes as their base letters.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: Unicode white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends; texts that begin and end with a visible ASCII character have none, which is quick to see."""
    return F.when(F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~"), c).otherwise(F.btrim(c, F.lit(SPACES)))


def collapse_spaces(c: Column) -> Column:
    """White space collapsed and trimmed; of visible ASCII characters with single spaces between them nothing is."""
    return F.when(F.regexp_like(c, F.lit("^[!-~]+(?: [!-~]+)*+\\z")), c).otherwise(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(SPACES)))


def text_key(c: Column) -> Column:
    """Trimmed, white space collapsed, lower case; null is empty."""
    return F.lower(collapse_spaces(blank(c)))


def alphanumeric_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(blank(c), r"[^\p{IsAlphabetic}\p{N}]", ""))


def label_value(c: Column) -> Column:
    """The trimmed text, or empty where it only says that there is no value."""
    text = trimmed(blank(c))
    # Few texts begin like one of them.
    start = F.regexp_like(blank(c), F.lit(rf"^[^\p{{IsAlphabetic}}\p{{N}}]*+[{PLACEHOLDER_STARTS}]"))
    return F.when(start & alphanumeric_upper(text).isin(PLACEHOLDER_LABELS), F.lit("")).otherwise(text)


def contains_ci(text: Column, part: str | Column) -> Column:
    """Case-insensitive substring; null has none, not even the empty one."""
    needle = F.lit(part.lower()) if isinstance(part, str) else F.lower(part)
    return F.coalesce(F.contains(F.lower(text), needle), F.lit(False))


def folded(c: Column) -> Column:
    """Lower case without Latin marks, as full-text tokens are compared."""
    return F.translate(F.lower(blank(c)), MARKED, PLAIN)


def search_tokens(*texts: Column) -> Column:
    """The distinct maximal runs of letters and digits of all texts, folded."""
    joined = folded(F.concat_ws(" ", *texts))
    return F.array_distinct(F.filter(F.split(joined, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != ""))


def header_text(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(blank(c), "^﻿", ""))


def extra_value(extra: Column, header: str) -> Column:
    """The first value of an extra column by its normalised header, or empty."""
    hits = F.filter(extra, lambda p: text_key(p["header"]) == text_key(F.lit(header)))
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def extra_values_text(extra: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(extra, F.array().cast("array<struct<header:string,value:string>>")), lambda p: p["value"]), " ")


def guard_formula(c: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a leading apostrophe; plain numbers stay."""
    head = F.substring(trimmed(blank(c)), 1, 1)
    number = F.regexp_like(trimmed(blank(c)), F.lit(r"^[+-]?[0-9]+([.,][0-9]+)?$"))
    return F.when(head.isin("=", "+", "-", "@") & ~number, F.concat(F.lit("'"), blank(c))).otherwise(blank(c))


def row_hash(values: list[Column], extra: Column | None = None) -> Column:
    """A hash of length-prefixed values; only its equality has meaning."""
    parts = [F.concat(F.octet_length(blank(v)).cast("string"), F.lit(":"), blank(v)) for v in values]
    if extra is not None:
        parts.append(F.coalesce(F.to_json(extra), F.lit("")))
    return F.sha2(F.concat(*parts), 256)

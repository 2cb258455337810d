"""Dates as texts: month keys, quarters, ISO forms, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, blank, trimmed

#: White space around a text, a number of a month and one of a day.
_S = f"[{SPACES}]*+"
_M, _D = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
#: What ends a date: nothing more, or a time after a space or a T.
_END = rf"(?:(?:\r\n|[\n\r\x85\u2028\u2029])?[ T].*|{_S})\z"


def month_key(c: Column) -> Column:
    """`YYYY-MM` of D.M.Y, else M.D.Y, or Y.M.D texts; else empty. Days are not checked."""
    text, out = blank(c), F.lit("")
    forms = (rf"([0-9]{{4}})[./-]{_M}[./-][0-9]{{1,2}}", 1, 2), (rf"{_M}[./-][0-9]{{1,2}}[./-]([0-9]{{4}})", 2, 1), (rf"[0-9]{{1,2}}[./-]{_M}[./-]([0-9]{{4}})", 2, 1)
    for form, year, month in forms:
        pattern = f"(?s)^{_S}{form}{_END}"
        found = F.concat(F.regexp_extract(text, pattern, year), F.lit("-"), F.lpad(F.regexp_extract(text, pattern, month), 2, "0"))
        out = F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(out)
    return out


def quarter_key(month: Column) -> Column:
    """`YYYY-Qn` of a month key; else empty."""
    m = F.substring(month, 6, 2).try_cast("int")
    return F.when(m.between(1, 12), F.concat(F.substring(month, 1, 4), F.lit("-Q"), F.ceil(m / 3).cast("string"))).otherwise(F.lit(""))


def normalize_date(c: Column) -> Column:
    """D.M.Y and Y.M.D texts as ISO dates where day and month can be; others unchanged."""
    text = out = blank(c)
    for form, y, m, d in ((rf"([0-9]{{4}})[./-]{_M}[./-]{_D}", 1, 2, 3), (rf"{_D}[./-]{_M}[./-]([0-9]{{4}})", 3, 2, 1)):
        pattern = rf"^{_S}{form}{_S}\z"
        iso = F.concat_ws("-", F.regexp_extract(text, pattern, y), F.lpad(F.regexp_extract(text, pattern, m), 2, "0"), F.lpad(F.regexp_extract(text, pattern, d), 2, "0"))
        out = F.when(F.regexp_like(text, F.lit(pattern)), iso).otherwise(out)
    return out


def date_text(c: Column) -> Column:
    """What dates are compared by: their normal form without surrounding space."""
    return trimmed(normalize_date(c))


def date_value(c: Column) -> Column:
    """The date_text of cells that begin with a date, else null."""
    return F.when(F.regexp_like(date_text(c), F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")), date_text(c))


#: Day numbers of a spreadsheet that are taken for dates anywhere (1968 to 2064), and its last one (9999-12-31).
FIRST_DAY, LIKELY_DAY, LAST_DAY = 25_000, 60_000, 2_958_465


def excel_date(c: Column, last: int = LIKELY_DAY) -> Column:
    """ISO date, with a time if there is one, of spreadsheet day numbers from 25 000 to the last (60 000); others null."""
    n = c.try_cast("double")
    seconds = F.round((n - F.floor(n)) * 86400).cast("int")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds), "yyyy-MM-dd HH:mm:ss")
    return F.when(n.between(FIRST_DAY, last), F.when(seconds == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(at))


def extract_year(c: Column) -> Column:
    """The first 19xx or 20xx that no digit touches."""
    return F.regexp_extract(blank(c), r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")


def parse_year(c: Column) -> Column:
    """The digits of a text if there are exactly four."""
    digits = F.regexp_replace(blank(c), "[^0-9]", "")
    return F.when(F.length(digits) == 4, digits.try_cast("int"))

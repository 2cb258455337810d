"""Locale-tolerant numbers as one Catalyst expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, trimmed

#: Characters between groups of digits besides point and comma.
GROUP_MARKS = " \u00a0\u202f\u2009'\u2019"
_SCIENTIFIC = r"^[+-]?(?=[0-9.,]*[0-9])[0-9]*[.,]?[0-9]*[eE][+-]?[0-9]+$"
_BROKEN_SCIENTIFIC = r"[0-9][eE]|[eE][+-]?[0-9]"
#: What may stand around a number: a unit or currency, but no digits, signs or separators.
_AROUND = r"[^0-9.,+'\u2019-]*+"


def _shape(body: str, ahead: str = "") -> str:
    return f"^{ahead}{_AROUND}([+-]?){body}{_AROUND}$"


def _grouped_digits(marks: str) -> str:
    return f"[0-9]{{1,3}}(?:[{marks}{GROUP_MARKS}][0-9]{{3}})+"


def _decimal(mark: str, other: str) -> str:
    """One decimal mark; the whole part is digits, groups by the other mark, or nothing."""
    return _shape(rf"([0-9]+|{_grouped_digits(other)}|)\{mark}([0-9]+)")


def _whole(mark: str) -> str:
    """No decimal mark: digits or groups, where `mark` isn't there or stands twice at least."""
    return _shape(f"([0-9]+|{_grouped_digits(mark)})", rf"(?=[^{mark}]*$|[^{mark}]*\{mark}[^{mark}]*\{mark})")


#: A lone separator before three digits, which may mean thousands.
_LONE = _shape(r"([1-9][0-9]{0,2})[.,]([0-9]{3})")


def reads_as_number(text: str) -> bool:
    """Whether num_value of a text is a number, by the same patterns; for samples on the driver."""
    text = text.strip()
    if re.search(_SCIENTIFIC, text):
        return True
    forms = (_LONE, _decimal(".", ","), _decimal(",", "."), _whole("."), _whole(","))
    return not re.search(_BROKEN_SCIENTIFIC, text) and any(re.search(f, text) for f in forms)


def num_value(c: Column, grouped: bool = False) -> Column:
    """The number a text says, or null.

    The last of point and comma is decimal if both occur; several of one kind are
    thousands.  One alone with three digits behind is decimal, or a thousands mark if
    `grouped`, unless the rest of the number decides.  Each form is one pattern over the
    text, so the expression stays small enough for whole-stage code.
    """
    text = trimmed(blank(c))
    # Most cells are plain already and need one pattern only.
    plain_text = r"^[+-]?([0-9]+|[0-9]*\.([0-9]{1,2}|[0-9]{4,}))$" if grouped else r"^[+-]?[0-9]*\.?[0-9]+$"
    # What has an exponent is scientific as a whole or no number.
    scientific = F.when(F.regexp_like(text, F.lit(_SCIENTIFIC)), F.replace(text, F.lit(","), F.lit(".")))
    forms = F.when(F.regexp_like(text, F.lit(plain_text)), text).when(F.regexp_like(text, F.lit(_BROKEN_SCIENTIFIC)), scientific)
    if grouped:
        forms = forms.when(F.regexp_like(text, F.lit(_LONE)), F.regexp_replace(text, _LONE, "$1$2$3"))
    for mark, other in (".", ","), (",", "."):
        pattern = _decimal(mark, other)
        # The point comes last, when the marks of groups are gone.
        forms = forms.when(F.regexp_like(text, F.lit(pattern)), F.translate(F.regexp_replace(text, pattern, "$1$2p$3"), f"p.,{GROUP_MARKS}", "."))
    for mark in ".,":
        pattern = _whole(mark)
        forms = forms.when(F.regexp_like(text, F.lit(pattern)), F.translate(F.regexp_replace(text, pattern, "$1$2"), f".,{GROUP_MARKS}", ""))
    # Each nullif takes its value once, where a condition and its result would parse it twice.
    infinite = F.lit(float("inf"))
    return F.nullif(F.nullif(forms.try_cast("double"), infinite), -infinite)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0 or nearly so."""
    tiny = F.abs(denominator) <= 2.220446049250313e-16
    return F.when(tiny, F.lit(0.0)).otherwise(numerator / F.when(tiny, F.lit(1.0)).otherwise(denominator))

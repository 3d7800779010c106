"""Scalar column rules shared by every operator (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or(c: Column | str, default: float = 0.0) -> Column:
    """NULL, NaN and infinities become ``default``."""
    x = col(c).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(x)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def clip(c: Column | str, lo: float = -1.0, hi: float = 1.0, digits: int = 6) -> Column:
    """Finite, clamped, rounded; anything else is 0."""
    return F.round(clamp(finite_or(c), lo, hi), digits)


def scale_linear(c: Column | str, lo: float, hi: float, invert: bool = False, digits: int = 6) -> Column:
    """Map [lo, hi] onto [-1, 1] (reversed ranges allowed), clamp, optionally flip."""
    if lo == hi:
        return F.lit(0.0)
    unit = (finite_or(c) - F.lit(float(lo))) / F.lit(float(hi - lo)) * 2 - 1
    out = clamp(unit, -1.0, 1.0)
    return F.round(-out if invert else out, digits)


def sanitise(c: Column | str, digits: int = 6) -> Column:
    return F.round(finite_or(c), digits)


def safe_div(a: Column, b: Column) -> Column:
    """NULL on a zero divisor (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ladder(c: Column | str, steps: Sequence[tuple[float, object]], otherwise: object, strict: bool = True) -> Column:
    """First threshold reached from the top wins: ``x > t`` (``>=`` when not strict)."""
    x = col(c)
    out = None
    for threshold, label in steps:
        hit = x > F.lit(threshold) if strict else x >= F.lit(threshold)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def ladder_below(c: Column | str, steps: Sequence[tuple[float, object]], otherwise: object, strict: bool = True) -> Column:
    """First threshold undercut wins: ``x < t`` (``<=`` when not strict)."""
    x = col(c)
    out = None
    for threshold, label in steps:
        hit = x < F.lit(threshold) if strict else x <= F.lit(threshold)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def lookup(c: Column | str, mapping: dict, default: object = None) -> Column:
    x, out = col(c), None
    for key, value in mapping.items():
        out = F.when(x == F.lit(key), F.lit(value)) if out is None else out.when(x == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def one_hot(c: Column | str, values: dict[str, str]) -> dict[str, Column]:
    """``{output column: value}`` to 0/1 integer columns."""
    return {name: (col(c) == F.lit(v)).cast("int") for name, v in values.items()}


def flag(cond: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def html_clean(c: Column | str) -> Column:
    """Strip tags, squeeze whitespace."""
    stripped = F.regexp_replace(col(c), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(stripped, r"\s+", " "))


def keyword_any(text: Column | str, terms: Iterable[str]) -> Column:
    low = F.lower(col(text))
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(low, F.lit(term.lower()))
    return out


def keyword_count(text: Column | str, terms: Iterable[str]) -> Column:
    """How many distinct terms occur (each once, as a substring)."""
    low = F.lower(col(text))
    out = F.lit(0)
    for term in terms:
        out = out + F.contains(low, F.lit(term.lower())).cast("int")
    return out


def normalise_ticker(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\.NS$", "")


def json_number(c: Column | str, path: str, divisor: float = 1.0) -> Column:
    """Number at ``path``; ``true`` is 1 and ``false`` 0."""
    text = F.get_json_object(col(c), path)
    return F.coalesce(text.try_cast("double"), F.when(text == "true", 1.0).when(text == "false", 0.0)) / F.lit(divisor)


def clean_number(c: Column | str) -> Column:
    """Thousands separators out, blanks and ``NA`` to NULL."""
    return F.regexp_replace(F.trim(col(c)), ",", "").try_cast("double")


TIME_FORMATS = (
    "EEE, dd MMM yyyy HH:mm:ss Z",
    "EEE, dd MMM yyyy HH:mm:ss z",
    "yyyyMMdd'T'HHmmss'Z'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)

DATE_FORMATS = ("yyyy-MM-dd", "dd-MMM-yyyy", "d MMM yyyy", "dd-MM-yyyy", "dd/MM/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def parse_time(c: Column | str, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """First format that parses; the weekday name, which carries no information, is dropped."""
    text = F.trim(col(c))
    tries = []
    for fmt in formats:
        body, f = text, fmt
        if fmt.startswith("EEE, "):
            body, f = F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), fmt.removeprefix("EEE, ").replace("dd", "d", 1)
        tries.append(F.try_to_timestamp(body, F.lit(f)))
    return F.coalesce(*tries)


def parse_date(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    text = F.initcap(F.trim(col(c)))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def monthly_expiry(d: Column | str) -> Column:
    """Last Thursday of the month; once past, that of the next month."""
    day = col(d)
    this = F.date_sub(F.next_day(F.last_day(day), "THU"), 7)
    nxt_month_end = F.last_day(F.add_months(F.trunc(day, "month"), 1))
    following = F.date_sub(F.next_day(nxt_month_end, "THU"), 7)
    return F.when(day <= this, this).otherwise(following)

"""Small text predicates and formatters built from Spark functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Python ``str.strip`` removes; a Java class body.
PY_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Line ends a Python ``str.splitlines`` splits on.
PY_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_blank(c: Column | str) -> Column:
    """Present and holding at least one non-whitespace character (never null)."""
    return F.coalesce(col(c).rlike(r"(?U)\S"), F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.when(non_blank(c), col(c))


def empty_to_null(c: Column | str) -> Column:
    return F.when(F.length(col(c)) > 0, col(c))


def py_strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def py_lines(c: Column | str) -> Column:
    return F.split(col(c), PY_LINE_END)


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when one of the words is a substring of already lower-cased text."""
    hits = [text.contains(w.lower()) for w in words]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def contains_all(text: Column, words: Iterable[str]) -> Column:
    hits = [text.contains(w.lower()) for w in words]
    out = hits[0]
    for hit in hits[1:]:
        out = out & hit
    return out


def bool_text(c: Column) -> Column:
    """Booleans print with a capital first letter."""
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def whole(c: Column) -> Column:
    """A double without its fraction, as a bigint within a billion of 0; not a number is 0."""
    inside = F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c))
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(inside).cast("bigint")


def stable_id(*parts: Column | str) -> Column:
    """32 hex characters that depend on the parts only, so a retried task agrees."""
    return F.substring(F.sha2(F.concat_ws(":", *[col(p) for p in parts]), 256), 1, 32)


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][XX][X]"


def parse_instant(c: Column | str) -> Column:
    """Offset date-time text to an instant; anything unreadable is null."""
    c = F.trim(col(c))
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c, F.lit(ISO_PATTERN)))

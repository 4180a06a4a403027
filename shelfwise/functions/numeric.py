"""Numeric column expressions: tolerant parsing, money, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

# Money is summed as DECIMAL so a total does not depend on row order, with six
# places so that no line is cut to cents; it is turned back into DOUBLE only at
# the interface.
MONEY = "decimal(28,6)"
# What counts as a number in a text, as Python's float() reads it
# (single underscores between digits, no type suffix as in 100D); NaN and
# Infinity count as missing.
DIGITS = "[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?({DIGITS}(\.({DIGITS})?)?|\.{DIGITS})([eE][+-]?{DIGITS})?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """The amount as DECIMAL; NULL when it does not fit."""
    return _col(c).try_cast(MONEY)


def try_double(c) -> Column:
    """String to DOUBLE; NULL when empty, not a number or beyond its range."""
    s = strip_ws(_col(c).cast("string"))
    # every step once: no match is an empty text, which is no number, and
    # nullif computes its argument once (a CASE would for test and value)
    v = F.replace(F.regexp_extract(s, NUMBER, 0), F.lit("_"), F.lit("")).try_cast("double")
    return F.nullif(F.nullif(v, F.lit(float("inf"))), F.lit(float("-inf")))


def finite(c) -> Column:
    """A DOUBLE column; NULL where it is NaN or infinite, as ``try_double`` reads
    it, without a way through text."""
    return F.when(F.abs(_col(c)) < F.lit(float("inf")), _col(c))


def try_long(c) -> Column:
    """String or number to BIGINT (a fraction is cut off); NULL when it is no
    number or does not fit."""
    s = strip_ws(_col(c).cast("string"))
    whole = F.when(s.rlike(r"^[+-]?[0-9]+$"), s).try_cast("bigint")
    return F.coalesce(whole, try_double(s).try_cast("bigint"))


def is_missing_text(c) -> Column:
    """The feed's "missing" predicate: NULL or the empty string."""
    c = _col(c)
    return c.isNull() | (c == "")


def impute_sales(total_sales_text, volume, unit_price):
    """Return ``(total_sales, is_imputed)`` columns.

    A parseable reported total is kept.  A missing or unparseable one is
    filled with ``volume * unit_price`` when both factors exist and the
    product is finite; otherwise it stays NULL.  ``is_imputed`` flags exactly
    the rows that were filled.
    """
    reported = try_double(total_sales_text)
    product = _col(volume).cast("double") * _col(unit_price).cast("double")
    filled = F.when(F.abs(product) < F.lit(float("inf")), product)
    total = F.coalesce(reported, filled)
    return total, reported.isNull() & filled.isNotNull()


def pct_change(cur, prev) -> Column:
    """``(cur - prev) / prev * 100``; NULL when ``prev`` is NULL or zero."""
    cur, prev = _col(cur).cast("double"), _col(prev).cast("double")
    return F.round((cur - prev) / F.nullif(prev, F.lit(0.0)) * 100, 2)


def ratio_pct(part, whole) -> Column:
    """``part / whole * 100``; NULL when ``whole`` is 0/NULL."""
    part, whole = _col(part).cast("double"), _col(whole).cast("double")
    return F.round(part / F.nullif(whole, F.lit(0.0)) * 100, 2)

"""Date parsing and the time attributes of a week."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip_ws

# Date layouts beside ISO ones that a feed's week column may use,
# tried in order; a day and month that could be either way round is month first.
WEEK_FORMATS = ("yyyy/M/d", "yyyy/M/d H:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm:ss", "M-d-yyyy",
                "d.M.yyyy", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
# An ISO date, with or without a time of day and a zone.
ISO = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def layout_shape(layout: str) -> str | None:
    """A pattern that every text of a date layout matches (and others may): a
    number for each number, any text for a month's name.  None for layouts of
    other letters, quotes or brackets."""
    if not re.fullmatch(r"(?:[yuMdHms]|[^A-Za-z'\[\]{}#])+", layout):
        return None
    out = re.sub(r"M{3,}|[yuMdHms]+|[^yuMdHms]+", lambda m: (
        "." if m[0].startswith("MMM") else "9" if m[0][0] in "yuMdHms" else f"<{m[0]}>"), layout)
    return "^" + re.sub(r"<([^>]*)>|9|\.", lambda m: (
        re.escape(m[1]) if m[1] else "[-+0-9]+" if m[0] == "9" else ".+"), out) + "$"


def _in_layout(s: Column, layout: str) -> Column:
    # a text that does not fit costs an exception with its stack trace, some ten
    # times as much as the pattern: only texts of the layout's shape are tried
    shape = layout_shape(layout)
    return F.try_to_timestamp(s if shape is None else F.when(s.rlike(shape), s), F.lit(layout))


def parse_date(c, formats=WEEK_FORMATS) -> Column:
    """Text to DATE: any ISO form, then each layout; NULL (not an error) when
    none fits, which ``quality_counts`` reports."""
    s = strip_ws(_col(c).cast("string"))
    iso = F.regexp_extract(s, ISO, 0).try_cast("timestamp")      # no match is no date
    return F.coalesce(iso, *[_in_layout(s, f) for f in formats]).cast("date")


def week_start(ts) -> Column:
    """Monday of the ISO week holding ``ts``, as DATE."""
    return F.date_trunc("week", _col(ts)).cast("date")


def time_attributes(df: DataFrame, col: str = "week_start") -> DataFrame:
    """Add calendar year, month, quarter, ISO week number and ISO year.

    ``year`` is the calendar year while ``week_number`` is the ISO week, so
    2024-12-30 is (2024, week 1); ``iso_year`` (2025 there) is given beside it.
    """
    d = F.col(col)
    return df.withColumns({
        "year": F.year(d).cast("bigint"),
        "month": F.month(d).cast("bigint"),
        "quarter": F.quarter(d).cast("bigint"),
        "week_number": F.weekofyear(d).cast("bigint"),
        "iso_year": F.expr(f"extract(YEAROFWEEK FROM `{col}`)").cast("bigint"),
    })

"""The metric layer: total revenue, year-over-year growth, market share.

Each metric has the scalar form (optional slices given as literals, never
pasted into SQL text) and a grouped form that answers all slices in one job.
Only the dimensions a metric needs are joined to the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact_sum import exact_sums, no_part, part
from ..functions.numeric import pct_change, ratio_pct

# dimension attribute -> (dimension table, its key)
ATTR_DIM = {
    "week_start": ("dim_time", "date_id"), "year": ("dim_time", "date_id"),
    "month": ("dim_time", "date_id"), "quarter": ("dim_time", "date_id"),
    "week_number": ("dim_time", "date_id"), "iso_year": ("dim_time", "date_id"),
    "sku_id": ("dim_product", "product_id"), "brand": ("dim_product", "product_id"),
    "variant": ("dim_product", "product_id"),
    "category": ("dim_category", "category_id"),
    "retailer": ("dim_retailer", "retailer_id"),
}


# The weekly summary: the internal fact aggregated to week x category x
# retailer x brand (``star.weekly_summary``).  Anything that needs only these
# attributes plus summed sales and volume reads it instead of the fact.
SUMMARY = "fact_weekly_summary"
SUMMARY_ATTRS = {"week_start", "year", "month", "quarter", "week_number", "iso_year",
                 "category", "retailer", "brand"}


def internal_fact(star: dict, attrs=(), use_summary: bool = True) -> DataFrame:
    """The internal fact to read for ``attrs``: the weekly summary when it
    exists and covers them (its sales and volume are already summed, so only
    sums may be taken from it), else the line-level fact."""
    if use_summary and SUMMARY in star and set(attrs) <= SUMMARY_ATTRS:
        return star[SUMMARY]
    return star["fact_internal_sales"]


def with_attrs(fact: DataFrame, star: dict, attrs) -> DataFrame:
    """Join the fact to just the dimensions holding ``attrs`` (attributes the
    fact already carries need no join)."""
    needed = {}
    for a in attrs:
        if a in fact.columns:
            continue
        dim, key = ATTR_DIM[a]
        needed.setdefault(dim, (key, []))[1].append(a)
    out = fact
    for dim, (key, cols) in needed.items():
        if key not in fact.columns:
            raise ValueError(f"{cols} ({dim}) cannot be reached from this fact")
        d = star[dim].select(key, *dict.fromkeys(cols))
        out = out.join(d, key)      # broadcast or not by the written table's size
    return out


def _filtered(fact: DataFrame, star: dict, filters: dict, extra=()) -> DataFrame:
    filters = {k: v for k, v in filters.items() if v is not None}
    df = with_attrs(fact, star, list(filters) + list(extra))
    for k, v in filters.items():
        df = df.filter(F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == F.lit(v))
    return df


def internal_lines(star: dict, attrs=(), use_summary: bool = True, **filters) -> DataFrame:
    """Internal fact rows with ``attrs`` attached and ``filters`` applied.

    Reads the weekly summary when it covers every attribute and filter, so
    callers may only sum ``total_sales`` and ``volume`` (never count rows)
    unless they pass ``use_summary=False``."""
    wanted = list(attrs) + [k for k, v in filters.items() if v is not None]
    return _filtered(internal_fact(star, wanted, use_summary), star, filters, attrs)


def sales(lines: DataFrame):
    """The sales of fact rows, or of the weekly summary's, as parts of exact
    sums (``functions.exact_sum``)."""
    if "scale" in lines.columns:
        return F.when(F.col("total_sales").isNotNull(),
                      F.struct("scale", F.col("total_sales").alias("amount")))
    return part("total_sales")


def revenue_of(lines: DataFrame, by=(), name: str = "total_revenue") -> DataFrame:
    """Exact revenue per ``by`` as DOUBLE; without keys one row, NULL on empty
    input."""
    return exact_sums(lines, by, {name: sales(lines)})


def total_revenue(star: dict, year: int | None = None, brand: str | None = None) -> DataFrame:
    """One row ``total_revenue``; NULL when nothing matches."""
    return revenue_of(internal_lines(star, year=year, brand=brand))


def revenue_by(star: dict, by, **filters) -> DataFrame:
    return revenue_of(internal_lines(star, attrs=by, **filters), by)


def _yearly(star: dict, by, **filters) -> DataFrame:
    return revenue_of(internal_lines(star, attrs=["year", *by], **filters), [*by, "year"], "revenue")


def _yoy_cols(cur, prev):
    return [cur.cast("double").alias("current_year_revenue"),
            prev.cast("double").alias("previous_year_revenue"),
            pct_change(cur, prev).alias("yoy_growth_percent")]


def yoy_growth_by(star: dict, by=(), **filters) -> DataFrame:
    """Growth of every year over the year before, per ``by`` group.

    The yearly sums are made once; the frame ``RANGE BETWEEN 1 PRECEDING AND 1
    PRECEDING`` on the year is exactly the previous calendar year, so a gap
    gives NULL (``lag`` would not), as does a previous revenue of 0.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("year").rangeBetween(-1, -1)
    y = _yearly(star, by, **filters).withColumn("prev_revenue", F.sum("revenue").over(w))
    return y.select(*by, F.col("year").alias("current_year"),
                    *_yoy_cols(F.col("revenue"), F.col("prev_revenue")))


def yoy_growth_join(star: dict, by=(), **filters) -> DataFrame:
    """Same result as ``yoy_growth_by`` with an equi self-join on ``(by, year - 1)``."""
    by = list(by)
    return _yoy_join(_yearly(star, by, **filters), by)


def yoy_growth(star: dict, year: int, brand: str | None = None) -> DataFrame:
    """``current_year, current_year_revenue, previous_year_revenue,
    yoy_growth_percent`` for one year; no row when the year has no sales."""
    y = _yearly(star, [], brand=brand, year=[year, year - 1])
    return _yoy_join(y, []).filter(F.col("current_year") == year)


def _yoy_join(y: DataFrame, by) -> DataFrame:
    prev = y.select(*by, (F.col("year") + 1).alias("year"), F.col("revenue").alias("prev_revenue"))
    return (y.join(prev, [*by, "year"], "left")
            .select(*by, F.col("year").alias("current_year"),
                    *_yoy_cols(F.col("revenue"), F.col("prev_revenue"))))


def _share_frame(star: dict, by, **filters) -> DataFrame:
    """Both facts at the common grain ``by`` in one aggregation.

    The two facts are projected onto ``(by, internal, competitor)`` and
    unioned, so one shuffle (with map-side partial sums) aggregates both; no
    fact-to-fact join, hence no fan-out between the grains.  ``t`` is the sum
    of both, rounded once.
    """
    wanted = list(by) + [k for k, v in filters.items() if v is not None]
    fi = _filtered(internal_fact(star, wanted), star, filters, by)
    fi = fi.select(*by, sales(fi).alias("i"), no_part().alias("c"))
    fc = _filtered(star["fact_competitor_market"], star, filters, by).select(
        *by, no_part().alias("i"), part("competitor_sales").alias("c"))
    # a side with no rows sums to NULL, like a SQL SUM over nothing
    return exact_sums(fi.unionByName(fc), by, {"i": F.col("i"), "c": F.col("c"),
                                               "t": F.coalesce("i", "c")})


def _share_cols():
    total = F.when(F.col("i").isNotNull() & F.col("c").isNotNull(), F.col("t"))
    return [F.col("i").alias("internal_sales"), F.col("c").alias("competitor_sales"),
            total.alias("total_market_sales"),
            ratio_pct(F.col("i"), total).alias("market_share_percent")]


def market_share(star: dict, year: int | None = None, category: str | None = None) -> DataFrame:
    """One row: internal_sales, competitor_sales, total_market_sales,
    market_share_percent = internal / (internal + competitor) * 100."""
    f = _share_frame(star, [], year=year, category=category)
    return f.select(*_share_cols())


def market_share_by(star: dict, by=("year", "category"), **filters) -> DataFrame:
    by = list(by)
    f = _share_frame(star, by, **filters)
    return f.select(*by, *_share_cols())

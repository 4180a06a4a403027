"""Comparisons, rankings and shares on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact_sum import again, cells, exact_sums, finish, kept_if, no_part, part
from ..functions.numeric import pct_change, ratio_pct
from .metrics import _filtered, internal_fact, internal_lines, revenue_of, sales


def compare_pivot(star: dict, by, pivot: str, values: dict, **filters) -> DataFrame:
    """Revenue of a few ``pivot`` values side by side, one row per ``by``.

    ``values`` maps each pivot value to its output column name.  Conditional
    sums in one aggregation (what ``pivot`` plans to), so the value list is
    fixed up front and no extra job discovers it.
    """
    by = list(by)
    lines = internal_lines(star, attrs=[*by, pivot], **filters).filter(
        F.col(pivot).isin(*values))
    return exact_sums(lines, by, {name: kept_if(F.col(pivot) == F.lit(v), sales(lines))
                                  for v, name in values.items()})


def pct_difference(star: dict, by, pivot: str, a: str, b: str, **filters) -> DataFrame:
    """Revenue of ``a`` and ``b`` and ``(a - b) / b * 100`` per ``by`` group."""
    f = compare_pivot(star, by, pivot, {a: "revenue_a", b: "revenue_b"}, **filters)
    return f.withColumn("pct_difference", pct_change("revenue_a", "revenue_b"))


def ranked(star: dict, dim: str, k: int = 1, ascending: bool = False, **filters) -> DataFrame:
    """Top (or bottom) ``k`` values of ``dim`` by revenue, ties broken by name.

    ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task
    keeps its own k best, so only k rows per task reach the final merge.
    """
    r = revenue_of(internal_lines(star, attrs=[dim], **filters), [dim])
    o = F.col("total_revenue").asc_nulls_last() if ascending else F.col("total_revenue").desc_nulls_last()
    return r.orderBy(o, F.col(dim).asc()).limit(k)


def top_k_per_group(star: dict, groups, dim: str, k: int = 3, **filters) -> DataFrame:
    """The ``k`` best ``dim`` values by revenue inside every ``groups`` slice.

    The window runs over the aggregated (groups, dim) table, partitioned by
    the groups, never over fact rows.
    """
    groups = list(groups)
    r = revenue_of(internal_lines(star, attrs=[*groups, dim], **filters), [*groups, dim])
    w = Window.partitionBy(*groups).orderBy(F.col("total_revenue").desc_nulls_last(), F.col(dim))
    return r.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def share_within(star: dict, outer: str, inner: str, **filters) -> DataFrame:
    """Share of each ``inner`` value in its ``outer`` total (e.g. brand share
    of category revenue), from the aggregated (outer, inner) table."""
    lines = internal_lines(star, attrs=[outer, inner], **filters)
    fine = cells(lines, [outer, inner], {"rev": sales(lines)})
    own = finish(fine, [outer, inner], ["rev"])
    whole = finish(again(fine, [outer]), [outer], ["tot"]).withColumnRenamed(outer, "__outer")
    return own.join(whole, F.col(outer).eqNullSafe(F.col("__outer"))).select(
        outer, inner, F.col("rev").alias(f"{inner}_revenue"), F.col("tot").alias(f"{outer}_revenue"),
        ratio_pct(F.col("rev"), F.col("tot")).alias("share_percent"))


def distinct_pairs(star: dict, a: str, b: str, **filters) -> DataFrame:
    """The distinct (a, b) combinations present in the internal fact."""
    return internal_lines(star, attrs=[a, b], **filters).select(a, b).distinct()


def internal_vs_competitor(star: dict, by=("year", "category"), **filters) -> DataFrame:
    """Internal and competitor volume and sales at a grain both facts share.

    Each fact is projected to the common grain and the two are unioned into
    one aggregation, so the coarse competitor rows are never repeated per
    internal row (no fact-to-fact join, no fan-out).
    """
    by = list(by)
    wanted = by + [k for k, v in filters.items() if v is not None]
    fi = _filtered(internal_fact(star, wanted), star, filters, by)
    fi = fi.select(
        *by, F.col("volume").cast("double").alias("iv"), F.lit(None).cast("double").alias("cv"),
        sales(fi).alias("isales"), no_part().alias("csales"))
    fc = _filtered(star["fact_competitor_market"], star, filters, by).select(
        *by, F.lit(None).cast("double").alias("iv"),
        F.col("competitor_volume").cast("double").alias("cv"),
        no_part().alias("isales"), part("competitor_sales").alias("csales"))
    return exact_sums(fi.unionByName(fc), by, {"internal_sales": F.col("isales"),
                                               "competitor_sales": F.col("csales")},
                      {"internal_volume": F.col("iv"), "competitor_volume": F.col("cv")})

"""Trends and roll-ups: period hierarchy, product hierarchy, moving windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact_sum import cells, grouping_sets
from ..functions.numeric import MONEY, money, pct_change
from .metrics import internal_lines, revenue_of, sales


def rollup_revenue(star: dict, levels, **filters) -> DataFrame:
    """Revenue at every prefix of ``levels`` (as ``ROLLUP``) plus the grand total.

    ``level_id`` is ``grouping_id()``: bit i (most significant first) is 1
    when level i is rolled up, so a NULL member and a subtotal never mix.  The
    lines are added up once, by all levels; each level is the sum of the next
    finer one, so no row of the fact is copied for each level (``Expand``).
    """
    levels = list(levels)
    lines = internal_lines(star, attrs=levels, **filters)
    volume = {"total_volume": F.col("volume")}
    finest = cells(lines, levels, {"total_revenue": sales(lines)}, volume)
    return grouping_sets(finest, levels, [levels[:n] for n in range(len(levels), -1, -1)],
                         ["total_revenue"], list(volume))


def period_trend(star: dict, entity: str, periods=("year", "quarter"), window: int = 3,
                 **filters) -> DataFrame:
    """Revenue per ``entity`` and period with the previous period's revenue,
    its % change and a moving average over the last ``window`` periods.

    The windows run over the aggregated (entity, period) table, partitioned by
    the entity; the fact is only scanned by the aggregation.
    """
    periods = list(periods)
    r = revenue_of(internal_lines(star, attrs=[entity, *periods], **filters), [entity, *periods], "rev")
    w = Window.partitionBy(entity).orderBy(*periods)
    prev = F.lag("rev").over(w)
    last = w.rowsBetween(-(window - 1), 0)
    # of the few totals in a window, as decimals where all of them are
    whole = F.count(money("rev")).over(last) == F.count("rev").over(last)
    total = F.when(whole, F.sum(money("rev")).over(last).cast("double")).otherwise(F.sum("rev").over(last))
    mean = total / F.count("rev").over(last)
    return r.select(entity, *periods,
                    F.col("rev").cast("double").alias("total_revenue"),
                    prev.cast("double").alias("previous_revenue"),
                    pct_change(F.col("rev"), prev).alias("change_percent"),
                    # rounded as a decimal: half a cent goes up on every engine
                    F.coalesce(F.round(mean.try_cast(MONEY), 2).cast("double"), mean).alias("moving_avg"))

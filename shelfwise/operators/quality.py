"""Data-quality checks of a star build, as DataFrames (no printing, no collect)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact_sum import exact_sums, kept_if
from ..functions.numeric import is_missing_text, ratio_pct, try_double
from .metrics import internal_lines, sales, with_attrs
from .resolve import UNKNOWN
from .star import STAR_TABLES


def _dropped(clean: DataFrame, star: dict, fact: str, keys: dict) -> DataFrame:
    """Rows of a cleaned feed that its fact does not have, by the first cause
    that holds: ``keys`` maps a cause to the dimension and the columns that an
    anti-join finds missing."""
    rows = clean.select(*dict.fromkeys(c for _, cols in keys.values() for c in cols))
    parts = []
    for cause, (dim, cols) in keys.items():
        have = star[dim].select(*cols)
        parts.append(rows.join(have, cols, "left_anti")
                     .agg(F.count(F.lit(1)).alias("value"))
                     .select(F.lit(f"dropped_{cause}").alias("check"),
                             F.lit(fact).alias("table_name"), "value"))
        rows = rows.join(have, cols, "left_semi")
    return reduce(DataFrame.unionByName, parts)


def quality_counts(star: dict, clean_internal: DataFrame | None = None,
                   clean_competitor: DataFrame | None = None,
                   records: DataFrame | None = None) -> DataFrame:
    """``(check, table_name, value)``: row counts, NULL sales in the internal
    fact, and, given the cleaned feeds, dates in no known layout and the rows
    that each fact join dropped, by cause (date, then product, then other).
    Given the record counts of the feeds' files, also the short records (their
    missing fields are NULL) and those refused for surplus fields."""
    def count(df, check, name):
        return df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(check).alias("check"), F.lit(name).alias("table_name"), "value")

    parts = [count(star[t], "row_count", t) for t in STAR_TABLES]
    fact = "fact_internal_sales"
    parts.append(count(star[fact].where("total_sales IS NULL"), "null_total_sales", fact))
    feeds = ((clean_internal, fact, {"date": ("dim_time", ["week_start"]),
                                     "product": ("dim_product", ["sku_id", "brand", "variant"]),
                                     "category": ("dim_category", ["category"]),
                                     "retailer": ("dim_retailer", ["retailer"])}),
             (clean_competitor, "fact_competitor_market",
              {"date": ("dim_time", ["week_start"]), "category": ("dim_category", ["category"]),
               "retailer": ("dim_retailer", ["retailer"])}))
    for clean, name, keys in feeds:
        if clean is not None:
            bad = F.col("week_start").isNull() & ~is_missing_text("reported_week")
            parts.append(count(clean.where(bad), "unparseable_date", name))
            parts.append(_dropped(clean, star, name, keys))
    if clean_competitor is not None:
        parts.append(count(clean_competitor.where("competitor_volume IS NULL"),
                           "null_competitor_volume", "fact_competitor_market"))
    if records is not None:
        tables = {"internal": fact, "competitor": "fact_competitor_market"}
        for state in ("short", "surplus"):
            for feed, name in tables.items():
                of = (F.col("feed") == feed) & (F.col("record_state") == state)
                parts.append(records.agg(F.coalesce(F.sum(F.when(of, F.col("records"))), F.lit(0))
                                         .alias("value"))
                             .select(F.lit(f"{state}_records").alias("check"),
                                     F.lit(name).alias("table_name"), "value"))
    return reduce(DataFrame.unionByName, parts).select(
        "check", "table_name", F.col("value").cast("bigint").alias("value"))


def unknown_audit(star: dict, attrs=("brand", "variant", "category", "retailer")) -> DataFrame:
    """Per fact and attribute: rows whose value is ``Unknown``, all rows, share."""
    def of(fact, attrs):
        lines = with_attrs(star[fact], star, list(attrs))
        return lines.select(F.lit(fact).alias("table_name"), F.explode(F.array(*[
            F.struct(F.lit(a).alias("attribute"), (F.col(a) == UNKNOWN).alias("is_unknown"))
            for a in attrs])).alias("x")).select("table_name", "x.*")

    shared = [a for a in attrs if a in ("category", "retailer")]
    stacked = of("fact_internal_sales", attrs)
    if shared:
        stacked = stacked.unionByName(of("fact_competitor_market", shared))
    return stacked.groupBy("table_name", "attribute").agg(
        F.count_if("is_unknown").cast("bigint").alias("unknown_rows"),
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
    ).withColumn("unknown_percent", ratio_pct("unknown_rows", "total_rows"))


def imputed_audit(star: dict, by=("year",)) -> DataFrame:
    """Imputed rows and the share of revenue that was imputed, per ``by``."""
    by = list(by)
    lines = internal_lines(star, attrs=by, use_summary=False)   # counts rows
    one = F.lit(1).cast("bigint")
    r = exact_sums(lines, by, {"imp": kept_if(F.col("is_imputed"), sales(lines)), "tot": sales(lines)},
                   {"imputed_rows": F.when(F.col("is_imputed"), one).otherwise(F.lit(0).cast("bigint")),
                    "total_rows": one})
    return r.select(*by, "imputed_rows", "total_rows", F.col("imp").alias("imputed_revenue"),
                    F.col("tot").alias("total_revenue"),
                    ratio_pct(F.col("imp"), F.col("tot")).alias("imputed_share_percent"))


def star_sample(star: dict, n: int = 5) -> DataFrame:
    """A few fact rows joined to all four dimensions (a join smoke test)."""
    f = with_attrs(star["fact_internal_sales"], star,
                   ["week_start", "brand", "category", "retailer"])
    cols = ["week_start", "brand", "category", "retailer", "volume", "total_sales"]
    return f.select(*cols).orderBy(*cols).limit(n)


def sales_text_audit(clean_internal: DataFrame, by=("year",)) -> DataFrame:
    """How the reported totals of the cleaned internal feed were read, per
    ``by``: missing (NULL or empty), present but unparseable, imputed, and
    still NULL after imputation."""
    by = list(by)
    missing = is_missing_text("reported_sales")
    g = clean_internal.groupBy(*by) if by else clean_internal
    return g.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_if(missing).cast("bigint").alias("missing_reported"),
        F.count_if(~missing & try_double("reported_sales").isNull()).cast("bigint")
        .alias("unparseable_reported"),
        F.count_if("is_imputed").cast("bigint").alias("imputed_rows"),
        F.count_if(F.col("total_sales").isNull()).cast("bigint").alias("null_sales"))

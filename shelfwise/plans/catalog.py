"""The registered queries: every operator of the library run on the given tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame.  The weekly
feeds are derived from the order tables (``sources.sales_feed``), cleaned and
resolved, and loaded into the star once per session and folder (the star is
written to the shared checkpoint folder, like a warehouse rebuilt at start);
the metric, comparison, trend and quality queries run on that star.
``shelfwise.plans.oracle`` holds the DuckDB SQL of each one.
"""

from __future__ import annotations

import threading
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date, time_attributes
from ..functions.exact_sum import exact_sums, part
from ..functions.numeric import impute_sales
from ..functions.text import clean_sku, typo
from ..operators import builds
from ..operators import compare as C
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import trend as T
from ..operators.clean import CUTOFF
from ..operators.resolve import (alias_index, match_exact, match_substring, resolve_spellings,
                                 typo_aliases)
from ..session import stage, staging_path, together
from ..sources.feeds import (INTERNAL_COLUMNS, read_alias_csv, read_internal_csv, read_records,
                             write_csv)
from ..sources.sales_feed import (FORMS, SKU_WIDTH, canonical_sets, messy, ragged_drop,
                                  raw_competitor_feed, raw_internal_feed, sales_lines)
from ..sources.tables import table
from ..streaming.weekly_ingest import ingest
from .rebuild import rebuild_from_csv
from .requests import answer_revenue_questions, generated_questions
from .sqlapi import run_sql

# The slices the scalar queries ask about.
YEAR = 1998
EMPTY_YEAR = 2023
BRAND = "Brand#13"
BRAND_B = "Brand#7"
CATEGORY = "PROMO"
CATEGORY_B = "STANDARD"
WEEK = 10
# a year pattern that also accepts 19xx (the given tables span 1995-2001)
YEAR_PATTERN_ANY = r"\b((?:19|20)\d{2})\b"
# The tables the feeds are derived from.
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
# What only the internal feed tells of a line.
INTERNAL_ONLY = ("l_orderkey", "l_linenumber", "p_partkey", "unit_price", "brand", "variant")

_lock = threading.RLock()
# What was landed and built, by session and folder: DataFrames (and the temp
# views registered from them) belong to the session that made them and go with it.
_landed: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_chains: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Folder, sizes and times of the source tables: a changed folder is
    landed anew."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = [sf_dir.rstrip("/")]
    for name in SOURCES:
        p = jvm.org.apache.hadoop.fs.Path(f"{out[0]}/{name}.parquet")
        fs = p.getFileSystem(conf)
        out += [fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()]
    return tuple(out)


def _once(cache, spark: SparkSession, sf_dir: str, make):
    with _lock:
        mine = cache.setdefault(spark, {})
        key = _stamp(spark, sf_dir)
        if key not in mine:
            mine[key] = make()
        return mine[key]


def aliases_for(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Alias tables generated by rule from the canonical values in the tables."""
    return together({k: lambda v=v: typo_aliases(v) for k, v in canonical_sets(spark, sf_dir).items()})


def land(spark: SparkSession, sf_dir: str) -> dict:
    """Derive the two raw feeds and the alias tables from the given tables and
    write them once as CSV, as files arriving from outside would be.  The
    lines of both feeds come from one scan of the order tables."""
    def make():
        # four lines in five are the competitors', whose feed knows no product
        lines = sales_lines(spark, sf_dir)
        lines = stage(lines.withColumns({c: F.when(F.col("is_internal"), F.col(c))
                                         for c in INTERNAL_ONLY}), "sales-lines")
        paths = {"internal": staging_path(spark, "feed-internal"),
                 "competitor": staging_path(spark, "feed-competitor")}
        paths["aliases"] = {k: staging_path(spark, f"alias-{k}") for k in CUTOFF}

        def internal():
            write_csv(raw_internal_feed(lines), paths["internal"])
            ragged_drop(lines).write.mode("append").text(paths["internal"])

        aliases = aliases_for(spark, sf_dir)
        together({"internal": internal,
                  "competitor": lambda: write_csv(raw_competitor_feed(lines), paths["competitor"]),
                  **{f"alias-{k}": lambda k=k: write_csv(aliases[k], paths["aliases"][k])
                     for k in aliases}})
        return paths
    return _once(_landed, spark, sf_dir, make)


def build(spark: SparkSession, sf_dir: str) -> dict:
    """Landed CSV feeds -> cleaned feeds -> written star, by the path a user
    calls; all tables written once and reused."""
    landed = land(spark, sf_dir)
    return _once(_built, spark, sf_dir, lambda: rebuild_from_csv(
        spark, landed["internal"], landed["competitor"], landed["aliases"],
        staging_path(spark, "star"), sku_digits=SKU_WIDTH))


def star_for(spark: SparkSession, sf_dir: str) -> dict:
    return build(spark, sf_dir)["star"]


def raw_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_internal_csv(spark, land(spark, sf_dir)["internal"])


# ---------------------------------------------------------------- cleaning


def q_clean_sku(spark, sf_dir):
    raw = raw_internal(spark, sf_dir).select("Reported_SKU").distinct()
    return raw.select(F.col("Reported_SKU").alias("raw_sku"),
                      clean_sku("Reported_SKU", SKU_WIDTH).alias("sku_id"))


def q_impute_sales(spark, sf_dir):
    raw = raw_internal(spark, sf_dir)
    total, flag = impute_sales("Total_Sales", "Volume", "Unit_Price")
    return raw.select(F.col("Total_Sales").alias("reported_sales"),
                      F.col("Volume").alias("volume"), F.col("Unit_Price").alias("unit_price"),
                      total.alias("total_sales"), flag.alias("is_imputed"))


def q_time_attributes(spark, sf_dir):
    raw = raw_internal(spark, sf_dir).select(F.col("Week_Start").alias("reported_week"))
    return time_attributes(raw.distinct().withColumn("week_start", parse_date("reported_week")))


CLEAN_INTERNAL_COLS = ["sku_id", "brand", "category", "retailer", "variant", "volume",
                       "total_sales", "is_imputed", "week_start", "year", "month", "quarter",
                       "week_number", "iso_year"]
CLEAN_COMPETITOR_COLS = ["category", "retailer", "competitor_volume", "competitor_sales",
                         "week_start", "year", "month", "quarter", "week_number", "iso_year"]


def q_clean_internal(spark, sf_dir):
    return build(spark, sf_dir)["internal"].select(*CLEAN_INTERNAL_COLS)


def q_clean_competitor(spark, sf_dir):
    return build(spark, sf_dir)["competitor"].select(*CLEAN_COMPETITOR_COLS)


def q_streamed_clean_internal(spark, sf_dir):
    """The landed internal feed's CSV files cleaned by the Structured
    Streaming ingest (availableNow): same rows as clean_internal."""
    landed = land(spark, sf_dir)
    aliases = {k: read_alias_csv(spark, p) for k, p in landed["aliases"].items()}
    out, ckpt = staging_path(spark, "streamed-internal"), staging_path(spark, "stream-ckpt")
    q = ingest(spark, "internal", landed["internal"], out, ckpt, aliases, sku_digits=SKU_WIDTH)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out).select(*CLEAN_INTERNAL_COLS)


def _yearly_brand(star):
    return M.revenue_by(star, ["year", "brand"])


def q_rebuild_roundtrip(spark, sf_dir):
    """CSV feeds -> rebuild -> written star -> read back -> revenue."""
    return _yearly_brand(star_for(spark, sf_dir))


def q_rebuild_twice(spark, sf_dir):
    """A star rebuilt over a former one from a changed feed (without the SKUs
    that end in an odd digit): the answer is the new star's alone."""
    landed, path = land(spark, sf_dir), staging_path(spark, "star-twice")
    rebuild_from_csv(spark, landed["internal"], landed["competitor"], landed["aliases"], path,
                     SKU_WIDTH)
    kept = read_records(spark, landed["internal"], "internal").where("record_state = 'whole'").select(
        *INTERNAL_COLUMNS)
    changed = staging_path(spark, "feed-changed")
    write_csv(kept.where(F.col("Reported_SKU").isNull()
                         | ~F.col("Reported_SKU").rlike("[13579] *$")), changed)
    again = rebuild_from_csv(spark, changed, landed["competitor"], landed["aliases"], path, SKU_WIDTH)
    return _yearly_brand(again["star"])


# The SKUs that come late, and the month that is taken back.
LATE_SKU = "[13579] *$"
TAKEN_BACK = "1998-03-%"


def chain(spark: SparkSession, sf_dir: str) -> dict:
    """Three rebuilds of one star: without the SKUs that end in an odd digit,
    of the whole feed, and without the lines dated in one month of the plain
    layout.  All three stay readable; ``stars`` were read as each was built."""
    def make():
        landed, path = land(spark, sf_dir), staging_path(spark, "star-chain")
        kept = stage(read_records(spark, landed["internal"], "internal").where(
            "record_state = 'whole'").select(*INTERNAL_COLUMNS), "kept")    # read twice
        sku, week = F.col("Reported_SKU"), F.col("Week_Start")
        feeds = {"early": kept.where(sku.isNull() | ~sku.rlike(LATE_SKU)), "whole": None,
                 "less": kept.where(week.isNull() | ~week.like(TAKEN_BACK))}
        stars = {}
        for name, df in feeds.items():
            feed = landed["internal"]
            if df is not None:
                feed = staging_path(spark, f"feed-{name}")
                write_csv(df, feed)
            stars[name] = rebuild_from_csv(spark, feed, landed["competitor"], landed["aliases"],
                                           path, SKU_WIDTH, keep=3)["star"]
        return {"path": path, "stars": stars}
    return _once(_chains, spark, sf_dir, make)


def q_rebuild_snapshot(spark, sf_dir):
    """A star that was read before two more rebuilds answers as it did."""
    return _yearly_brand(chain(spark, sf_dir)["stars"]["early"])


def q_rebuild_stable_keys(spark, sf_dir):
    """Products after a rebuild that brought new ones: the old keep their ids."""
    return chain(spark, sf_dir)["stars"]["whole"]["dim_product"].select(
        "product_id", "sku_id", "brand", "variant")


def q_rebuild_incremental(spark, sf_dir):
    """The star after a month's lines were taken back: revenue of each year, its
    weeks with sales, and how many of them the rebuild wrote."""
    c = chain(spark, sf_dir)
    star, path = c["stars"]["less"], c["path"]
    name = builds.current(spark, path)
    weeks = (builds.weeks_table(spark, path, name).where("fact = 'fact_internal_sales'")
             .join(star["dim_time"].select("date_id", "year"), "date_id").groupBy("year")
             .agg(F.count(F.lit(1)).alias("weeks"),
                  F.count_if(F.col("build") == name).alias("weeks_written")))
    return M.revenue_by(star, ["year"]).join(weeks, "year")


# -------------------------------------------------------------- resolution


def brand_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported brand spellings for every part: exact, contained and fuzzy
    forms, NULL and junk, chosen by ``p_partkey % 9``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    b, m = F.col("p_brand"), F.pmod(F.col("p_partkey"), F.lit(9))
    raw = (F.when(m == 1, F.upper(b))
           .when(m == 2, F.concat(F.lit("  "), F.lower(b), F.lit(" ")))
           .when(m == 3, typo(b, 2, "x"))
           .when(m == 4, F.concat(b, F.lit(" Ltd")))
           .when(m == 5, F.concat(F.lit("the "), F.lower(b), F.lit(" co")))
           .when(m == 6, typo(typo(b, 2, "z"), 4, "q"))
           .when(m == 7, F.lit(None).cast("string"))
           .when(m == 8, F.upper(typo(typo(b, 3, "z"), 5, "q")))
           .otherwise(b))
    return p.select(raw.alias("raw")).distinct()


def _brand_index(spark, sf_dir):
    return alias_index(typo_aliases(canonical_sets(spark, sf_dir)["brand"]))


def q_resolve_exact(spark, sf_dir):
    vals = brand_spellings(spark, sf_dir).filter(F.col("raw").isNotNull()).withColumn("e", F.lit(0))
    return match_exact(vals, _brand_index(spark, sf_dir)).select("raw", "canonical")


def q_resolve_substring(spark, sf_dir):
    index = _brand_index(spark, sf_dir)
    vals = brand_spellings(spark, sf_dir).filter(F.col("raw").isNotNull()).withColumn("e", F.lit(0))
    left = vals.join(match_exact(vals, index).select("e", "raw"), ["e", "raw"], "left_anti")
    return match_substring(left, index).select("raw", "canonical")


# A variant spelling as near to ``ring`` as to ``gear``.
TIED = "grgq"


def resolution_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, raw): every form of every canonical value, its first half
    followed by ``q`` (a ratio between 0.4 and 0.5), and a tie."""
    out = None
    for entity, names in canonical_sets(spark, sf_dir).items():
        forms = names.withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(FORMS - 1))))
        raw = forms.select(messy(F.col("canonical"), F.col("form"), entity != "brand").alias("raw"))
        if entity != "brand":
            n, h = F.length("canonical"), F.floor(F.length("canonical") / 2).cast("int")
            raw = raw.unionByName(names.where(n > 3).select(
                F.concat(F.expr("left(canonical, int(length(canonical) / 2))"),
                         F.repeat(F.lit("q"), (4 * h - n - 1).cast("int"))).alias("raw")))
        if entity == "variant":
            raw = raw.unionByName(spark.range(1).select(F.lit(TIED).alias("raw")))
        raw = raw.select(F.lit(entity).alias("entity"), "raw")
        out = raw if out is None else out.unionByName(raw)
    return out.where(F.col("raw").isNotNull()).distinct()


def q_resolve_fuzzy(spark, sf_dir):
    """All four tiers and Unknown, for all four entities and both cutoffs."""
    cases = resolution_cases(spark, sf_dir)
    frames = [(cases.where(F.col("entity") == e).select("raw"), {"raw": e}) for e in sorted(CUTOFF)]
    return resolve_spellings(frames, aliases_for(spark, sf_dir), CUTOFF)


# -------------------------------------------------------------------- star


def _star_table(name):
    def q(spark, sf_dir):
        return star_for(spark, sf_dir)[name]
    q.__name__ = f"q_{name}"
    return q


# ----------------------------------------------------------------- metrics


def q_total_revenue(spark, sf_dir):
    return M.total_revenue(star_for(spark, sf_dir))


def q_total_revenue_filtered(spark, sf_dir):
    return M.total_revenue(star_for(spark, sf_dir), year=YEAR, brand=BRAND)


def q_brand_revenue(spark, sf_dir):
    return M.total_revenue(star_for(spark, sf_dir), brand=BRAND)


def q_total_revenue_year_brand(spark, sf_dir):
    return M.revenue_by(star_for(spark, sf_dir), ["year", "brand"])


def q_total_revenue_empty_year(spark, sf_dir):
    return M.total_revenue(star_for(spark, sf_dir), year=EMPTY_YEAR, brand=BRAND)


def q_yoy_growth(spark, sf_dir):
    return M.yoy_growth(star_for(spark, sf_dir), YEAR)


def q_yoy_growth_brand(spark, sf_dir):
    return M.yoy_growth(star_for(spark, sf_dir), YEAR, brand=BRAND)


def q_yoy_growth_by_brand(spark, sf_dir):
    return M.yoy_growth_by(star_for(spark, sf_dir), ["brand"])


def q_yoy_growth_window(spark, sf_dir):
    return M.yoy_growth_join(star_for(spark, sf_dir), ["brand"])


def q_market_share(spark, sf_dir):
    return M.market_share(star_for(spark, sf_dir), year=YEAR, category=CATEGORY)


def q_market_share_total(spark, sf_dir):
    return M.market_share(star_for(spark, sf_dir))


def q_market_share_by_year_category(spark, sf_dir):
    return M.market_share_by(star_for(spark, sf_dir), ["year", "category"])


# ------------------------------------------------------------- comparisons


def q_compare_brands_pivot(spark, sf_dir):
    return C.compare_pivot(star_for(spark, sf_dir), ["year"], "brand",
                           {BRAND: "brand_a_revenue", BRAND_B: "brand_b_revenue"})


def q_pct_difference(spark, sf_dir):
    return C.pct_difference(star_for(spark, sf_dir), ["year"], "brand", BRAND, BRAND_B)


def q_volume_in_year(spark, sf_dir):
    lines = M.internal_lines(star_for(spark, sf_dir), year=YEAR)
    return lines.agg(F.sum("volume").alias("total_volume"))


def q_week_revenue(spark, sf_dir):
    lines = M.internal_lines(star_for(spark, sf_dir), year=YEAR, week_number=WEEK, brand=BRAND)
    return M.revenue_of(lines)


def q_top_brand_in_category(spark, sf_dir):
    return C.ranked(star_for(spark, sf_dir), "brand", 1, year=YEAR, category=CATEGORY)


def q_bottom_brand(spark, sf_dir):
    return C.ranked(star_for(spark, sf_dir), "brand", 1, ascending=True)


def q_top_k_per_group(spark, sf_dir):
    return C.top_k_per_group(star_for(spark, sf_dir), ["year", "category"], "brand", 3)


def q_larger_category(spark, sf_dir):
    return C.ranked(star_for(spark, sf_dir), "category", 1, year=YEAR,
                    category=[CATEGORY, CATEGORY_B])


def q_brand_share_in_category(spark, sf_dir):
    return C.share_within(star_for(spark, sf_dir), "category", "brand")


def q_brands_in_category(spark, sf_dir):
    return C.distinct_pairs(star_for(spark, sf_dir), "category", "brand")


def q_internal_vs_competitor_slice(spark, sf_dir):
    return C.internal_vs_competitor(star_for(spark, sf_dir), [], year=YEAR, category=CATEGORY)


def q_internal_vs_competitor_volume(spark, sf_dir):
    return C.internal_vs_competitor(star_for(spark, sf_dir), ["year", "category"])


# ------------------------------------------------------------------ trends


def q_period_rollup(spark, sf_dir):
    return T.rollup_revenue(star_for(spark, sf_dir), ["year", "quarter", "month", "week_start"])


def q_hierarchy_rollup(spark, sf_dir):
    return T.rollup_revenue(star_for(spark, sf_dir), ["category", "brand", "variant", "sku_id"])


def q_quarterly_trend(spark, sf_dir):
    return T.period_trend(star_for(spark, sf_dir), "category", ["year", "quarter"], 3)


# ----------------------------------------------------------------- quality


def q_quality_counts(spark, sf_dir):
    b = build(spark, sf_dir)
    return Q.quality_counts(b["star"], b["internal"], b["competitor"], b["records"])


def q_unknown_audit(spark, sf_dir):
    return Q.unknown_audit(star_for(spark, sf_dir))


def q_imputed_audit(spark, sf_dir):
    return Q.imputed_audit(star_for(spark, sf_dir), ["year"])


def q_sales_text_audit(spark, sf_dir):
    return Q.sales_text_audit(build(spark, sf_dir)["internal"], ["year"])


def q_star_sample(spark, sf_dir):
    return Q.star_sample(star_for(spark, sf_dir), 5)


# ------------------------------------------------------------ sql, requests

ADHOC_SQL = """
WITH own AS (
  SELECT category_id, date_id, is_imputed, CAST(total_sales AS DECIMAL(28,6)) AS amount
  FROM fact_internal_sales WHERE volume > 5)
SELECT category, quarter, SUM(amount) AS revenue,
       COUNT(DISTINCT date_id) AS weeks_sold, COUNT_IF(is_imputed) AS imputed_lines
FROM own INNER JOIN dim_category USING (category_id) INNER JOIN dim_time USING (date_id)
GROUP BY category, quarter
"""


def q_adhoc_sql(spark, sf_dir):
    df = run_sql(spark, ADHOC_SQL, star_for(spark, sf_dir))
    return df.withColumn("revenue", F.col("revenue").cast("double"))


def q_kpi_requests(spark, sf_dir):
    star = star_for(spark, sf_dir)
    answers = answer_revenue_questions(star, generated_questions(star),
                                       year_pattern=YEAR_PATTERN_ANY)
    return stage(answers, "question-answers")       # the report: a dataset, read back


def q_ledger_balance(spark, sf_dir):
    """Exact sums of amounts of very different size: beside every own line, a
    large amount is posted and taken back, so that only sums which lose
    nothing give the lines' own."""
    lines = sales_lines(spark, sf_dir).where("is_internal")
    large = F.col("volume") * F.lit(1e22)
    entries = lines.select("category", F.explode(F.array(
        F.col("amount").cast("double"), large, -large)).alias("entry"))
    return exact_sums(entries, ["category"], {"balance": part("entry")})


def q_total_revenue_from_fact(spark, sf_dir):
    """The same total from the line-level fact, past the weekly summary."""
    return M.revenue_of(M.internal_lines(star_for(spark, sf_dir), use_summary=False))


def queries() -> dict:
    star_tables = {n: _star_table(n) for n in
                   ("dim_time", "dim_product", "dim_category", "dim_retailer",
                    "fact_internal_sales", "fact_competitor_market")}
    return {
        "clean_sku": q_clean_sku,
        "impute_sales": q_impute_sales,
        "time_attributes": q_time_attributes,
        "clean_internal": q_clean_internal,
        "clean_competitor": q_clean_competitor,
        "streamed_clean_internal": q_streamed_clean_internal,
        "rebuild_roundtrip": q_rebuild_roundtrip,
        "rebuild_twice": q_rebuild_twice,
        "rebuild_snapshot": q_rebuild_snapshot,
        "rebuild_stable_keys": q_rebuild_stable_keys,
        "rebuild_incremental": q_rebuild_incremental,
        "resolve_exact": q_resolve_exact,
        "resolve_substring": q_resolve_substring,
        "resolve_fuzzy": q_resolve_fuzzy,
        **star_tables,
        "quality_counts": q_quality_counts,
        "unknown_audit": q_unknown_audit,
        "imputed_audit": q_imputed_audit,
        "star_sample": q_star_sample,
        "sales_text_audit": q_sales_text_audit,
        "total_revenue": q_total_revenue,
        "ledger_balance": q_ledger_balance,
        "total_revenue_from_fact": q_total_revenue_from_fact,
        "total_revenue_filtered": q_total_revenue_filtered,
        "brand_revenue": q_brand_revenue,
        "total_revenue_year_brand": q_total_revenue_year_brand,
        "total_revenue_empty_year": q_total_revenue_empty_year,
        "yoy_growth": q_yoy_growth,
        "yoy_growth_brand": q_yoy_growth_brand,
        "yoy_growth_by_brand": q_yoy_growth_by_brand,
        "yoy_growth_window": q_yoy_growth_window,
        "market_share": q_market_share,
        "market_share_total": q_market_share_total,
        "market_share_by_year_category": q_market_share_by_year_category,
        "compare_brands_pivot": q_compare_brands_pivot,
        "pct_difference": q_pct_difference,
        "volume_in_year": q_volume_in_year,
        "week_revenue": q_week_revenue,
        "top_brand_in_category": q_top_brand_in_category,
        "bottom_brand": q_bottom_brand,
        "top_k_per_group": q_top_k_per_group,
        "larger_category": q_larger_category,
        "brand_share_in_category": q_brand_share_in_category,
        "brands_in_category": q_brands_in_category,
        "internal_vs_competitor_volume": q_internal_vs_competitor_volume,
        "internal_vs_competitor_slice": q_internal_vs_competitor_slice,
        "period_rollup": q_period_rollup,
        "hierarchy_rollup": q_hierarchy_rollup,
        "quarterly_trend": q_quarterly_trend,
        "adhoc_sql": q_adhoc_sql,
        "kpi_requests": q_kpi_requests,
    }

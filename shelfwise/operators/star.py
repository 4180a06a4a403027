"""Star schema: conformed dimensions with dense surrogate keys, two facts.

``fact_internal_sales`` is at SKU x retailer x week grain and
``fact_competitor_market`` at category x retailer x week; both share
``dim_time``, ``dim_category`` and ``dim_retailer`` (conformed: the union of
both feeds' values), ``dim_product`` comes from the internal feed only.

Surrogate ids follow the natural-key order in the first build; in later ones
members keep their ids and new ones come after them (``stable_key``).  Joins use plain equality, so rows with a
NULL key (e.g. a missing SKU) are dropped from the facts, as a SQL star load
would drop them; ``quality_counts`` reports how many and why.

A written star lives in a folder of its own build; a pointer file names the
current one and is replaced last, so readers see one build or the other, never
a mixture, and the weekly summary always belongs to its facts.  A build that
follows another writes only the weeks that changed (``builds``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact_sum import cells, part
from ..session import stage, together
from . import builds
from .keys import stable_key

TIME_COLS = ["week_start", "year", "month", "quarter", "week_number", "iso_year"]
STAR_TABLES = ("dim_time", "dim_product", "dim_category", "dim_retailer",
               "fact_internal_sales", "fact_competitor_market")


# The natural key of each dimension, and the column that numbers it.
DIM_KEYS = {"dim_time": ("date_id", ["week_start"]),
            "dim_product": ("product_id", ["sku_id", "brand", "variant"]),
            "dim_category": ("category_id", ["category"]),
            "dim_retailer": ("retailer_id", ["retailer"])}


def _numbered(name: str, members: DataFrame, known: dict | None) -> DataFrame:
    id_col, keys = DIM_KEYS[name]
    return stable_key(members, (known or {}).get(name), keys, id_col)


def dim_time(internal: DataFrame, competitor: DataFrame, known: dict | None = None) -> DataFrame:
    """One row per week, about 52 a year.  A week that comes late is numbered
    after all others, wherever it lies in the calendar."""
    weeks = (internal.select(*TIME_COLS).unionByName(competitor.select(*TIME_COLS))
             .filter(F.col("week_start").isNotNull()).distinct())
    if known is None:   # bounded by construction: numbered in one partition
        return weeks.withColumn("date_id", F.row_number().over(
            Window.orderBy("week_start")).cast("bigint")).select("date_id", *TIME_COLS)
    return _numbered("dim_time", weeks, known)


def dim_product(internal: DataFrame, known: dict | None = None) -> DataFrame:
    """Grows with the SKU count: numbered by range partitions with offsets."""
    return _numbered("dim_product", internal.select("sku_id", "brand", "variant").distinct(), known)


def _conformed(name: str, internal: DataFrame, competitor: DataFrame,
               known: dict | None) -> DataFrame:
    """Union of both feeds' resolved values: canonical values plus Unknown.
    The caller's alias table decides how many, so they are numbered like the
    products."""
    col = DIM_KEYS[name][1][0]
    return _numbered(name, internal.select(col).unionByName(competitor.select(col)).distinct(),
                     known)


def dim_category(internal: DataFrame, competitor: DataFrame,
                 known: dict | None = None) -> DataFrame:
    return _conformed("dim_category", internal, competitor, known)


def dim_retailer(internal: DataFrame, competitor: DataFrame,
                 known: dict | None = None) -> DataFrame:
    return _conformed("dim_retailer", internal, competitor, known)


def fact_internal_sales(internal: DataFrame, dims: dict) -> DataFrame:
    """No join is forced: the dimensions are written tables, so Spark
    broadcasts those whose bytes allow it and shuffles for the others."""
    return (internal
            .join(dims["dim_time"].select("date_id", "week_start"), "week_start")
            .join(dims["dim_product"], ["sku_id", "brand", "variant"])
            .join(dims["dim_category"], "category")
            .join(dims["dim_retailer"], "retailer")
            .select("date_id", "product_id", "category_id", "retailer_id",
                    F.col("volume").cast("double").alias("volume"),
                    F.col("total_sales").cast("double").alias("total_sales"),
                    F.col("is_imputed").cast("boolean").alias("is_imputed")))


def fact_competitor_market(competitor: DataFrame, dims: dict) -> DataFrame:
    return (competitor
            .join(dims["dim_time"].select("date_id", "week_start"), "week_start")
            .join(dims["dim_category"], "category")
            .join(dims["dim_retailer"], "retailer")
            .select("date_id", "category_id", "retailer_id",
                    F.col("competitor_volume").cast("bigint").alias("competitor_volume"),
                    F.col("competitor_sales").cast("double").alias("competitor_sales")))


def weekly_summary(star: dict) -> DataFrame:
    """The internal fact aggregated to week x category x retailer x brand.

    Bounded by weeks x categories x retailers x brands, whatever the line
    count, and enough for every revenue/volume question that does not ask
    for SKU or variant.  Sales are exact sums by scale (``exact_sum.cells``), so
    adding cells gives the same totals as adding lines.
    """
    lines = star["fact_internal_sales"].join(
        star["dim_product"].select("product_id", "brand"), "product_id")
    keys = ["date_id", "category_id", "retailer_id", "brand"]
    sums = cells(lines, keys, {"total_sales": part("total_sales")}, {"volume": F.col("volume")})
    return sums.select(*keys, "scale", F.col("amount").alias("total_sales"), "volume")


def dimensions(internal: DataFrame, competitor: DataFrame, known: dict | None = None,
               materialize: bool = False) -> dict[str, DataFrame]:
    """The four dimensions, numbered at the same time (each has its own jobs)."""
    make = {"dim_time": lambda: dim_time(internal, competitor, known),
            "dim_product": lambda: dim_product(internal, known),
            "dim_category": lambda: dim_category(internal, competitor, known),
            "dim_retailer": lambda: dim_retailer(internal, competitor, known)}
    return together({t: (lambda t=t: stage(make[t](), t)) if materialize else make[t]
                     for t in DIM_KEYS})


def build_star(internal: DataFrame, competitor: DataFrame, materialize: bool = True,
               known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Cleaned feeds -> the six star tables.

    With ``materialize`` the dimensions are written to the shared checkpoint
    folder first, as the facts and every later query read them.  The cleaned
    feeds should be written tables.  The facts stay lazy.  ``known`` holds the
    keys given so far (``builds.read_keys``): members in it keep their ids.
    """
    dims = dimensions(internal, competitor, known, materialize)
    return {**dims,
            "fact_internal_sales": fact_internal_sales(internal, dims),
            "fact_competitor_market": fact_competitor_market(competitor, dims)}


FACT_COLS = {
    "fact_internal_sales": ["date_id", "product_id", "category_id", "retailer_id",
                            "volume", "total_sales", "is_imputed"],
    "fact_competitor_market": ["date_id", "category_id", "retailer_id",
                               "competitor_volume", "competitor_sales"],
}
FACT_KEYS = {"fact_internal_sales": ["date_id", "product_id"],
             "fact_competitor_market": ["date_id", "category_id"]}
FACT_SCHEMA = {
    "fact_internal_sales": "product_id bigint, category_id bigint, retailer_id bigint, "
                           "volume double, total_sales double, is_imputed boolean, "
                           "date_id bigint",
    "fact_competitor_market": "category_id bigint, retailer_id bigint, "
                              "competitor_volume bigint, competitor_sales double, "
                              "date_id bigint",
}
SUMMARY = "fact_weekly_summary"


def _write_fact(df: DataFrame, name: str, path: str, fact_partitions: int | None) -> None:
    # a deterministic row hash as the last range key: rows of one hot (week,
    # product) spread over several tasks instead of one.  Without an explicit
    # count AQE sizes the ranges (advisory partition size), so files come out
    # near that size at any scale.
    keys = [*FACT_KEYS[name], F.xxhash64(*df.columns)]
    ranged = (df.repartitionByRange(fact_partitions, *keys) if fact_partitions
              else df.repartitionByRange(*keys))
    ranged.write.partitionBy("date_id").parquet(f"{path}/{name}")


def week_digests(fact: DataFrame) -> DataFrame:
    """(date_id, lines, digest): the content of each week, whatever the order of
    its lines.  Two sums of 64-bit hashes, added as decimals within the tasks."""
    def added(*cols):
        return F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).cast("string")
    return fact.groupBy("date_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.concat_ws(":", added(*fact.columns), added(F.lit("again"), *fact.columns)).alias("digest"))


def write_star(star: dict[str, DataFrame], path: str, mode: str = "overwrite",
               fact_partitions: int | None = None, base: str | None = None,
               keep: int = 1, min_age: float = 0.0) -> None:
    """Write the star as parquet.  ``mode='overwrite'`` is the full rebuild;
    ``'ignore'`` keeps an existing star (create-if-not-exists).

    All tables go to a new build folder, and the pointer is replaced when all
    are complete.  Of the former builds the newest ``keep`` - 1 stay, and all that
    were replaced less than ``min_age`` seconds ago, so a star read before still
    answers.  Facts are range-clustered on ``date_id`` before a
    ``partitionBy('date_id')`` write: each task then holds a few weeks, so the
    file count stays near the task count, and a filter on ``dim_time`` prunes
    fact partitions at run time (dynamic partition pruning).

    ``base`` names the build whose keys numbered this star.  Its ids still hold, so
    only weeks whose lines differ from it are written and summed up again;
    the others are read where they are.  Without ``base`` the keys start anew
    and all weeks are written.
    """
    if mode not in ("overwrite", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, path = star["dim_time"].sparkSession, path.rstrip("/")
    if mode == "ignore" and builds.current(spark, path):
        return
    name = builds.new_name()
    build = f"{path}/{name}"
    together({t: (lambda t=t: star[t].write.parquet(f"{build}/{t}")) for t in DIM_KEYS})
    builds.write_keys(spark, path, name, base,
                      {t: spark.read.parquet(f"{build}/{t}") for t in DIM_KEYS}, DIM_KEYS)
    held = builds.read_weeks(spark, path, base) if base and builds.blocks(
        spark, path, base) < builds.MERGE_AFTER else []

    def write_changed(t: str) -> tuple[list[tuple], list]:
        lines = stage(star[t], t)     # the joins run once; digests and writing read this
        former = {(w.date_id, w.lines, w.digest): w.build for w in held if w.fact == t}
        found = [(t, d.date_id, d.lines, d.digest,
                  former.get((d.date_id, d.lines, d.digest), name))
                 for d in week_digests(lines).collect()]      # one row per week
        mine = [w[1] for w in found if w[4] == name]
        if len(mine) < len(found):
            lines = lines.where(F.col("date_id").isin(mine))
        if mine:
            _write_fact(lines, t, build, fact_partitions)
        return found, mine

    written = together({t: lambda t=t: write_changed(t) for t in FACT_COLS})
    weeks = [w for found, _ in written.values() for w in found]
    changed = {t: mine for t, (_, mine) in written.items()}
    builds.write_weeks(spark, path, name, weeks)
    own = _read_build(spark, path, name)
    same = [w[1] for w in weeks if w[0] == "fact_internal_sales" and w[4] != name]
    if same:
        own["fact_internal_sales"] = own["fact_internal_sales"].where(
            F.col("date_id").isin(changed["fact_internal_sales"]))
    summary = weekly_summary(own)
    if same:
        summary = summary.unionByName(spark.read.parquet(f"{path}/{base}/{SUMMARY}")
                                      .where(F.col("date_id").isin(same)))
    summary.write.parquet(f"{build}/{SUMMARY}")
    builds.finish(spark, path, name, keep, min_age)


def current_build(spark: SparkSession, path: str) -> str | None:
    """Folder of the build that the pointer at ``path`` names; None without one."""
    name = builds.current(spark, path)
    return f"{path.rstrip('/')}/{name}" if name else None


def _read_build(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    out = {t: spark.read.parquet(f"{path}/{name}/{t}") for t in DIM_KEYS}
    weeks = builds.read_weeks(spark, path, name)
    for t, cols in FACT_COLS.items():
        parts = []
        for b in sorted({w.build for w in weeks if w.fact == t}):   # at most MERGE_AFTER
            root = f"{path}/{b}/{t}"
            mine = [f"{root}/date_id={w.date_id}" for w in weeks if w.fact == t and w.build == b]
            parts.append(spark.read.schema(FACT_SCHEMA[t]).option("basePath", root).parquet(*mine))
        fact = (reduce(DataFrame.unionByName, parts) if parts
                else spark.createDataFrame([], FACT_SCHEMA[t]))
        out[t] = fact.select(*cols)
    return out


def read_star(spark: SparkSession, path: str, build: str | None = None) -> dict[str, DataFrame]:
    """Read the current build of a written star, or an older one by its name
    (``builds.complete``); facts get their column order back (``date_id`` comes
    back as a partition column)."""
    path = path.rstrip("/")
    build = build or builds.current(spark, path)
    if build is None:
        raise FileNotFoundError(f"no star at {path}")
    return {**_read_build(spark, path, build),
            SUMMARY: spark.read.parquet(f"{path}/{build}/{SUMMARY}")}


def register_star(star: dict[str, DataFrame]) -> None:
    """Expose the six star tables as temporary views under their own names.
    The weekly summary is none: its amounts are in units of their scale."""
    for n in STAR_TABLES:
        if n in star:
            star[n].createOrReplaceTempView(n)

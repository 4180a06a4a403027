"""Weekly sales feeds derived from the driver's order tables.

The given tables have no weekly-sales feed, so one set of rules turns them
into the two feeds a retailer would receive; the DuckDB oracle states the same
rules in SQL (``shelfwise.plans.oracle``), so both engines see the same input.

* a line is *internal* when its supplier is in region AMERICA, otherwise it is
  competitor volume;
* category = part type, brand = part brand, variant = second word of the part
  name, retailer = customer market segment, week = ISO Monday of the ship date;
* the internal feed keeps one row per line (SKU x retailer x week grain) with
  spellings, SKU codes, totals, prices and dates corrupted by rules on the keys;
* the competitor feed is aggregated to category x retailer x week.

The corrupted spellings reach every resolution tier, and each rule fixes the
answer by construction: a padded, re-cased or one-letter form is an alias key; a
name inside other words contains its own key and no other; a name with a ``q``
in it is nearer to itself than to any other; NULL and junk resemble nothing and
are ``Unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import week_start
from ..functions.text import typo
from ..session import stage
from .tables import table

# The region whose suppliers count as our own (internal) sales.
INTERNAL_REGION = "AMERICA"


def suppliers_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys whose nation is in the internal region.

    nation (25 rows) and region (5 rows) are fixed-size tables, so their
    broadcast is bounded; the supplier side grows with the data and is
    filtered by a semi join, whose size estimate is the supplier table's own.
    """
    t = lambda n: table(spark, sf_dir, n)
    cond = F.col("r_name") == INTERNAL_REGION
    nations = (t("nation").select("n_nationkey", "n_regionkey")
               .join(F.broadcast(t("region").filter(cond)
                                 .select("r_regionkey")),
                     F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"))
    return (t("supplier").select("s_suppkey", "s_nationkey")
            .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
            .select("s_suppkey"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level view of both feeds with their sales attributes;
    ``is_internal`` tells whether the supplier is in the internal region.

    One scan of the lines.  What is joined to them is made ready on its own
    side.  The supplier flag and the orders' retailers come from joins whose
    size no estimate knows (Spark multiplies the sides, and would shuffle all
    lines to meet a few suppliers), so they are staged: their joins with the
    lines go by written sizes.  The lines are shuffled at most once by order,
    still narrow, and once by part, which brings the wide columns last.
    """
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        week_start("l_shipdate").alias("week_start"))
    inside = suppliers_in_region(spark, sf_dir).withColumn("own", F.lit(True))
    everyone = stage(t("supplier").select("s_suppkey").join(inside, "s_suppkey", "left").select(
        "s_suppkey", F.coalesce("own", F.lit(False)).alias("is_internal")), "suppliers")
    buyers = stage(t("orders").select("o_orderkey", "o_custkey").join(
        t("customer").select("c_custkey", F.col("c_mktsegment").alias("retailer")),
        F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "retailer"), "buyers")
    k = F.col("p_partkey")
    p = t("part").select(
        "p_partkey",
        # prices below a cent, so that a rounded factor would show
        (F.col("p_retailprice") + F.pmod(k, F.lit(8)) * F.lit(0.125)).alias("unit_price"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("variant"))
    lines = (li.join(everyone, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
             .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(p, F.col("l_partkey") == F.col("p_partkey")))
    return lines.select("l_orderkey", "l_linenumber", "p_partkey", "volume", "unit_price", "amount",
                        "week_start", "category", "brand", "variant", "retailer", "is_internal")


def _by(key: Column, n: int, cases: dict, default: Column) -> Column:
    """Pick a spelling by ``key % n``."""
    m = F.pmod(key, F.lit(n))
    out = None
    for k, v in cases.items():
        out = F.when(m == k, v) if out is None else out.when(m == k, v)
    return out.otherwise(default)


# Digits of a display code (it holds every part key), the text
# that stands for no entity, and the forms of a name by ``key % FORMS``.
SKU_WIDTH = 9
JUNK = "qqqqqqqqqqqqqqqqqqqqqqqq"
FORMS = 20
FORM_NULL, FORM_JUNK = 17, 18
# One order in so many has a line break in its retailer; the late
# drop reports one early order in so many.
BREAK_EVERY = 2000
RAGGED_EVERY, RAGGED_UP_TO = 100, 20_000


def messy(name: Column, key: Column, contained: bool = True) -> Column:
    """A reported spelling of ``name``.  ``contained``: also inside other words
    (not for names that hold another name, like Brand#13 and Brand#1)."""
    inside = F.concat(F.lit("the "), F.lower(name), F.lit(" co")) if contained else name
    return _by(key, FORMS, {
        8: F.upper(name),
        9: F.concat(F.lit("  "), F.lower(name), F.lit("\t")),
        10: typo(name, 2, "x"),
        11: F.concat(name, F.lit("\u00a0")),
        12: F.concat(F.lit("\u3000 "), F.upper(name)),
        13: inside,
        14: F.concat(F.lit("\u00a0"), inside, F.lit(" ")),
        15: typo(name, 2, "q"),
        16: F.lower(typo(name, 2, "q")),
        19: F.upper(typo(name, 2, "q")),
        FORM_NULL: F.lit(None).cast("string"),
        FORM_JUNK: F.lit(JUNK)}, name)


def sku_code(partkey) -> Column:
    """Display code of a part, as wide as ``SKU_WIDTH``."""
    return F.lpad(F.col(partkey).cast("string"), SKU_WIDTH, "0")


def raw_internal_feed(lines: DataFrame, extra=()) -> DataFrame:
    """The internal weekly feed as received: messy text, string totals; with
    the columns ``extra`` of the lines behind."""
    s = lines.where("is_internal")
    k, o = F.col("p_partkey"), F.col("l_orderkey")
    ln = o + F.col("l_linenumber")
    code, amount = sku_code("p_partkey"), F.col("amount").cast("string")
    week = F.col("week_start")
    return s.select(
        _by(k, 10, {0: F.lit(None).cast("string"),
                    1: F.concat(F.lit("sku a"), code),
                    2: F.concat(F.lit("SKU-"), code, F.lit("7")),
                    3: F.concat(F.lit(" sku-"), code, F.lit("\u00a0")),
                    4: F.concat(F.lit("SKU-"), F.translate(code, "0", "Z")),
                    5: F.when(F.pmod(k, F.lit(100)) == 5, F.lit("unassigned"))
                        .otherwise(F.concat(F.lit("SKU-"), code))},
            F.concat(F.lit("SKU-"), code)).alias("Reported_SKU"),
        messy(F.col("brand"), k, contained=False).alias("Reported_Brand"),
        messy(F.col("category"), k + F.col("l_linenumber")).alias("Reported_Category"),
        # now and then with a line break, which a CSV file has to quote
        F.when(F.pmod(o, F.lit(BREAK_EVERY)) == 9, F.concat(F.lower("retailer"), F.lit(" \n")))
        .otherwise(messy(F.col("retailer"), o)).alias("Reported_Retailer"),
        messy(F.col("variant"), ln).alias("Reported_Variant"),
        F.col("volume").alias("Volume"),
        F.when(F.pmod(ln, F.lit(20)) != 0, F.col("unit_price")).alias("Unit_Price"),
        _by(ln, 10, {0: F.lit(None).cast("string"),
                     3: F.lit(""),
                     2: F.when(F.pmod(k, F.lit(3)) == 1, F.concat(
                         F.left(amount, F.lit(1)), F.lit("_"), F.expr("substr(CAST(amount AS STRING), 2)")))
                         .otherwise(amount),
                     5: F.when(F.pmod(k, F.lit(2)) == 0, F.lit("n/a")).otherwise(amount),
                     6: F.when(F.pmod(k, F.lit(3)) == 0, F.lit("1e400")).otherwise(amount),
                     7: F.when(F.pmod(k, F.lit(2)) == 0, F.concat(amount, F.lit("D")))
                         .otherwise(F.concat(F.lit("\u00a0"), amount, F.lit(" "))),
                     8: F.when(F.pmod(k, F.lit(4)) == 0, F.lit("approx. 12"))
                         .otherwise(amount)}, amount).alias("Total_Sales"),
        _by(o, 20, {2: F.date_format(week, "yyyy/MM/dd"),
                    3: F.date_format(week, "yyyy-MM-dd'T'HH:mm:ss"),
                    4: F.date_format(week, "yyyy-MM-dd HH:mm:ss.SSS"),
                    5: F.date_format(week, "yyyy-M-d"),
                    6: F.date_format(week, "MM/dd/yyyy"),
                    7: F.date_format(week, "MM-dd-yyyy"),
                    8: F.date_format(week, "d MMM yyyy"),
                    9: F.lit("week unknown")},
            F.date_format(week, "yyyy-MM-dd")).alias("Week_Start"), *extra)


def ragged_lines(lines: DataFrame) -> DataFrame:
    """Internal lines of some early orders, which a late drop reports again as
    records that are not whole."""
    k = F.col("l_orderkey")
    return lines.where(F.col("is_internal") & (k <= RAGGED_UP_TO)
                       & (F.pmod(k, F.lit(RAGGED_EVERY)) == 3))


def ragged_drop(lines: DataFrame) -> DataFrame:
    """``value``: a CSV file's text, header first, of the late drop: records of
    odd line numbers have a surplus field, the others lack their last one.
    One file, of a bounded number of orders."""
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
    rows = ragged_lines(lines)
    odd = F.pmod(F.col("l_linenumber"), F.lit(2)) == 1
    fields = raw_internal_feed(rows.withColumn("odd", odd), extra=["odd"])
    names = [c for c in fields.columns if c != "odd"]
    text = F.when(F.col("odd"), F.concat(F.to_csv(F.struct(*names), options), F.lit(",late"))
                  ).otherwise(F.to_csv(F.struct(*names[:-1]), options))
    header = rows.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(",".join(names)).alias("value"))
    return (header.unionByName(fields.select(F.lit(1).alias("n"), text.alias("value")))
            .coalesce(1).sortWithinPartitions("n").select("value"))


def raw_competitor_feed(lines: DataFrame) -> DataFrame:
    """The competitor feed as received: category x retailer x week totals."""
    agg = lines.where("NOT is_internal").groupBy("category", "retailer", "week_start").agg(
        F.sum("volume").cast("bigint").alias("Competitor_Volume"),
        F.sum("amount").cast("double").alias("Competitor_Sales"))
    d, week = F.dayofyear("week_start"), F.col("week_start")
    return agg.select(
        messy(F.col("category"), d).alias("Reported_Category"),
        messy(F.col("retailer"), d + F.year("week_start")).alias("Reported_Retailer"),
        F.when(F.pmod(d, F.lit(11)) == 3, F.lit("1e30"))
         .otherwise(F.col("Competitor_Volume").cast("string")).alias("Competitor_Volume"),
        "Competitor_Sales",
        _by(d, 30, {4: F.lit("week unknown"), 9: F.date_format(week, "yyyy/M/d")},
            F.date_format(week, "yyyy-MM-dd")).alias("Week_Start"))


def canonical_sets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Canonical values per entity, read from the dimension-like tables."""
    p = table(spark, sf_dir, "part")
    c = table(spark, sf_dir, "customer")
    return {
        "brand": p.select(F.col("p_brand").alias("canonical")).distinct(),
        "category": p.select(F.col("p_type").alias("canonical")).distinct(),
        "variant": p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("canonical")).distinct(),
        "retailer": c.select(F.col("c_mktsegment").alias("canonical")).distinct(),
    }

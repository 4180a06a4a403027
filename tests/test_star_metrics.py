import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.dates import time_attributes
from shelfwise.operators import compare as C
from shelfwise.operators import metrics as M
from shelfwise.operators import quality as Q
from shelfwise.operators import trend as T
from shelfwise.operators.keys import dense_key
from shelfwise.operators.star import build_star, current_build, read_star, write_star

D = dt.date


@pytest.fixture(scope="module")
def star(spark):
    internal = spark.createDataFrame([
        # sku, brand, category, retailer, variant, volume, total_sales, imputed, week
        ("SKU-0001", "Arlo", "Lamps", "Harbor", "Matte", 10.0, 100.0, False, D(2023, 1, 2)),
        ("SKU-0001", "Arlo", "Lamps", "Harbor", "Matte", 5.0, 50.0, True, D(2024, 1, 1)),
        ("SKU-0002", "Croaker", "Lamps", "Quay", "Raw", 1.0, 30.0, False, D(2024, 1, 8)),
        ("SKU-0003", "Basalt", "Tiles", "Quay", "Gloss", 2.0, None, False, D(2024, 12, 30)),
        (None, "Basalt", "Tiles", "Quay", "Gloss", 7.0, 70.0, False, D(2024, 1, 8)),
        ("SKU-0004", "Tansy", "Tiles", "Harbor", "Matte", 3.0, 0.0, False, D(2022, 6, 6)),
    ], "sku_id string, brand string, category string, retailer string, variant string, "
       "volume double, total_sales double, is_imputed boolean, week_start date")
    competitor = spark.createDataFrame([
        ("Lamps", "Harbor", 100, 900.0, D(2024, 1, 1)),
        ("Tiles", "Cellar", 50, 400.0, D(2024, 1, 15)),
        ("Rugs", "Harbor", 5, 10.0, D(2021, 3, 1)),
    ], "category string, retailer string, competitor_volume bigint, competitor_sales double, "
       "week_start date")
    return build_star(time_attributes(internal), time_attributes(competitor), materialize=False)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is not None, x) for x in t))


def test_dimensions_conformed_and_dense(star):
    assert rows(star["dim_category"], "category_id", "category") == [
        (1, "Lamps"), (2, "Rugs"), (3, "Tiles")]
    assert rows(star["dim_retailer"], "retailer") == [("Cellar",), ("Harbor",), ("Quay",)]
    t = rows(star["dim_time"], "date_id", "week_start", "year", "week_number", "iso_year")
    assert [r[0] for r in t] == list(range(1, 8))   # 7 distinct weeks over both feeds
    assert (D(2024, 12, 30), 2024, 1, 2025) in [r[1:] for r in t]
    p = rows(star["dim_product"], "product_id", "sku_id")
    assert p[0] == (1, None) and [r[0] for r in p] == [1, 2, 3, 4, 5]


def test_fact_drops_null_sku_only(star):
    f = star["fact_internal_sales"]
    assert f.count() == 5
    assert star["fact_competitor_market"].count() == 3


def test_dense_key_matches_row_number(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("k"),
                                             (F.col("id") % 3).cast("string").alias("s"))
    df = df.union(spark.createDataFrame([(None, None)], "k bigint, s string")).distinct()
    want = rows(df, "k", "s")
    for parts in (5, None):    # explicit count, and AQE-sized ranges
        got = rows(dense_key(df, ["k", "s"], "id", partitions=parts), "id", "k", "s")
        assert [r[0] for r in got] == list(range(1, len(want) + 1))
        assert [r[1:] for r in got] == want


def test_total_revenue(star):
    assert M.total_revenue(star).collect()[0][0] == 180.0
    assert M.total_revenue(star, year=2024, brand="Arlo").collect()[0][0] == 50.0
    empty = M.total_revenue(star, year=2019).collect()
    assert len(empty) == 1 and empty[0][0] is None


def test_yoy(star):
    r = M.yoy_growth(star, 2024).collect()
    assert len(r) == 1 and r[0].current_year_revenue == 80.0 and r[0].previous_year_revenue == 100.0
    assert r[0].yoy_growth_percent == -20.0
    assert M.yoy_growth(star, 2019).count() == 0                      # no current year: no row
    r = M.yoy_growth(star, 2023, brand="Arlo").collect()[0]
    assert r.previous_year_revenue is None and r.yoy_growth_percent is None  # no previous year
    by = {(r.brand, r.current_year): r.yoy_growth_percent for r in M.yoy_growth_by(star, ["brand"]).collect()}
    win = {(r.brand, r.current_year): r.yoy_growth_percent
           for r in M.yoy_growth_join(star, ["brand"]).collect()}
    assert by == win and by[("Arlo", 2024)] == -50.0


def test_yoy_zero_previous_is_null(spark):
    # previous-year revenue of exactly 0: growth is NULL, not an error or inf
    internal = spark.createDataFrame([
        ("S1", "Tansy", "Tiles", "Harbor", "Matte", 1.0, 0.0, False, D(2022, 6, 6)),
        ("S1", "Tansy", "Tiles", "Harbor", "Matte", 1.0, 40.0, False, D(2023, 6, 5)),
    ], "sku_id string, brand string, category string, retailer string, variant string, "
       "volume double, total_sales double, is_imputed boolean, week_start date")
    comp = internal.selectExpr("category", "retailer", "1L AS competitor_volume",
                               "1.0 AS competitor_sales", "week_start").limit(0)
    s = build_star(time_attributes(internal), time_attributes(comp), materialize=False)
    r = {x.current_year: x for x in M.yoy_growth_by(s, ["brand"]).collect()}
    assert r[2023].previous_year_revenue == 0.0 and r[2023].yoy_growth_percent is None
    w = {x.current_year: x for x in M.yoy_growth_join(s, ["brand"]).collect()}
    assert w[2023].yoy_growth_percent is None


def test_market_share(star):
    r = M.market_share(star, year=2024, category="Lamps").collect()[0]
    assert (r.internal_sales, r.competitor_sales, r.total_market_sales) == (80.0, 900.0, 980.0)
    assert r.market_share_percent == round(80 / 980 * 100, 2)
    g = {(x.year, x.category): x for x in M.market_share_by(star).collect()}
    assert g[(2021, "Rugs")].internal_sales is None and g[(2021, "Rugs")].market_share_percent is None
    assert g[(2023, "Lamps")].competitor_sales is None
    empty = M.market_share(star, year=2030).collect()[0]
    assert empty.internal_sales is None and empty.market_share_percent is None


def test_share_sums_to_100(star):
    for x in M.market_share_by(star).collect():
        if x.market_share_percent is not None and x.total_market_sales:
            other = round(x.competitor_sales / x.total_market_sales * 100, 2)
            assert abs(x.market_share_percent + other - 100) < 0.011


def test_rollup_subtotals_add_up(star):
    r = T.rollup_revenue(star, ["year", "quarter"]).collect()
    total = [x.total_revenue for x in r if x.level_id == 3][0]
    years = sum(x.total_revenue or 0 for x in r if x.level_id == 1)
    leaves = sum(x.total_revenue or 0 for x in r if x.level_id == 0)
    assert total == years == leaves == 180.0


def test_compare_and_rank(star):
    piv = C.pct_difference(star, ["year"], "brand", "Arlo", "Croaker").filter("year = 2024").collect()[0]
    assert (piv.revenue_a, piv.revenue_b, piv.pct_difference) == (50.0, 30.0, 66.67)
    assert C.ranked(star, "brand", 1).collect()[0].brand == "Arlo"
    assert C.ranked(star, "brand", 1, ascending=True).collect()[0].brand == "Tansy"
    top = C.top_k_per_group(star, ["category"], "brand", 1).collect()
    assert sorted((r.category, r.brand) for r in top) == [("Lamps", "Arlo"), ("Tiles", "Tansy")]
    iv = {(r.year, r.category): r for r in C.internal_vs_competitor(star).collect()}
    assert iv[(2024, "Lamps")].internal_volume == 6.0
    assert iv[(2024, "Lamps")].competitor_volume == 100.0   # not repeated per internal row


def test_quality(star):
    q = {(r.check, r.table_name): r.value for r in Q.quality_counts(star).collect()}
    assert q[("row_count", "fact_internal_sales")] == 5
    assert q[("null_total_sales", "fact_internal_sales")] == 1
    imp = {r.year: r for r in Q.imputed_audit(star).collect()}
    assert imp[2024].imputed_rows == 1 and imp[2024].imputed_revenue == 50.0


def test_write_and_read_star(spark, star, tmp_path):
    write_star(star, str(tmp_path / "star"))
    back = read_star(spark, str(tmp_path / "star"))
    assert back["fact_internal_sales"].columns == star["fact_internal_sales"].columns
    assert M.total_revenue(back).collect()[0][0] == 180.0


def test_write_star_spreads_a_hot_key(spark, star, tmp_path):
    # one (week, product) holding well over a third of the rows must not land
    # in a single write task
    from pyspark.sql import functions as F
    hot = spark.range(3000).select(F.lit(1).cast("bigint").alias("date_id"),
                                   F.lit(2).cast("bigint").alias("product_id"),
                                   F.lit(1).cast("bigint").alias("category_id"),
                                   F.lit(1).cast("bigint").alias("retailer_id"),
                                   F.col("id").cast("double").alias("volume"),
                                   (F.col("id") * 1.5).alias("total_sales"),
                                   F.lit(False).alias("is_imputed"))
    cold = spark.range(2000).select((F.col("id") % 7 + 1).alias("date_id"),
                                    (F.col("id") % 50).alias("product_id"),
                                    F.lit(1).cast("bigint").alias("category_id"),
                                    F.lit(1).cast("bigint").alias("retailer_id"),
                                    F.col("id").cast("double").alias("volume"),
                                    F.col("id").cast("double").alias("total_sales"),
                                    F.lit(False).alias("is_imputed"))
    s2 = dict(star)
    s2["fact_internal_sales"] = hot.unionByName(cold)
    write_star(s2, str(tmp_path / "hot"), fact_partitions=8)
    build = tmp_path / "hot" / current_build(spark, str(tmp_path / "hot")).rsplit("/", 1)[-1]
    files = list((build / "fact_internal_sales" / "date_id=1").glob("*.parquet"))
    assert len(files) >= 3
    back = spark.read.parquet(str(build / "fact_internal_sales"))
    assert back.count() == 5000


def test_rebuild_gives_the_same_tables(spark):
    # ids follow natural-key order, so a rebuild over shuffled input is identical
    from pyspark.sql import functions as F
    rows = [(f"SKU-{i % 37:04d}", f"B{i % 5}", f"C{i % 3}", f"R{i % 4}", f"V{i % 6}",
             float(i % 11), float(i), i % 9 == 0, D(2024, 1, 1) + dt.timedelta(weeks=i % 20))
            for i in range(400)]
    schema = ("sku_id string, brand string, category string, retailer string, variant string, "
              "volume double, total_sales double, is_imputed boolean, week_start date")
    comp_schema = ("category string, retailer string, competitor_volume bigint, "
                   "competitor_sales double, week_start date")
    comp = [(f"C{i % 4}", f"R{i % 5}", i, float(i), D(2023, 6, 5) + dt.timedelta(weeks=i))
            for i in range(30)]
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(list(reversed(rows)), schema).repartition(7, F.rand(3))
    ca = spark.createDataFrame(comp, comp_schema)
    cb = spark.createDataFrame(list(reversed(comp)), comp_schema).repartition(3)
    s1 = build_star(time_attributes(a), time_attributes(ca), materialize=False)
    s2 = build_star(time_attributes(b), time_attributes(cb), materialize=False)
    for name in s1:
        cols = s1[name].columns
        assert rows_of(s1[name], cols) == rows_of(s2[name], cols), name


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is not None, x) for x in t))


def test_weekly_summary_gives_the_fact_answers(spark, star):
    from shelfwise.operators.star import weekly_summary
    with_summary = dict(star, fact_weekly_summary=weekly_summary(star))
    checks = [
        lambda s: M.total_revenue(s, year=2024),
        lambda s: M.revenue_by(s, ["year", "brand"]),
        lambda s: M.yoy_growth_by(s, ["brand"]),
        lambda s: M.market_share_by(s),
        lambda s: C.internal_vs_competitor(s),
        lambda s: C.top_k_per_group(s, ["category"], "brand", 2),
        lambda s: T.rollup_revenue(s, ["year", "quarter"]),
    ]
    for q in checks:
        a, b = q(star), q(with_summary)
        assert rows(a, *a.columns) == rows(b, *b.columns)
    # SKU-level questions still read the line-level fact
    from shelfwise.operators.metrics import internal_fact
    assert internal_fact(with_summary, ["sku_id"]) is star["fact_internal_sales"]
    assert internal_fact(with_summary, ["year", "brand"]) is with_summary["fact_weekly_summary"]

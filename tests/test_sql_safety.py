import datetime as dt

import pytest

from shelfwise.functions.dates import time_attributes
from shelfwise.operators.star import build_star, weekly_summary
from shelfwise.plans.sqlapi import NotAQuery, check_query, run_sql


@pytest.fixture(scope="module")
def star(spark):
    internal = spark.createDataFrame([
        (f"S{i % 3}", f"Brand{i % 2}", f"Cat{i % 2}", f"Shop{i % 3}", "v", float(i), 10.0 * i, i % 4 == 0,
         dt.date(2023 + i % 2, 1, 2) + dt.timedelta(days=7 * i)) for i in range(24)],
        "sku_id string, brand string, category string, retailer string, variant string, "
        "volume double, total_sales double, is_imputed boolean, week_start date")
    rival = internal.selectExpr("category", "retailer", "int(volume) AS competitor_volume",
                                "total_sales * 2 AS competitor_sales", "week_start")
    out = build_star(time_attributes(internal), time_attributes(rival), materialize=False)
    return out | {"fact_weekly_summary": weekly_summary(out)}


FACT = "fact_internal_sales f JOIN dim_time t USING (date_id)"
# Shapes of questions: totals, slices, comparisons, rankings, shares, growth, pivots.
SHAPES = [
    "SELECT SUM(total_sales) FROM fact_internal_sales",
    f"SELECT SUM(total_sales) AS s FROM {FACT} WHERE year = 2024",
    f"SELECT SUM(f.volume) FROM {FACT} JOIN dim_product p ON f.product_id = p.product_id "
    "WHERE p.brand ILIKE 'brand1' AND t.year = 2023",
    f"SELECT year, SUM(CASE WHEN brand = 'Brand0' THEN total_sales END) a, SUM(CASE WHEN brand = 'Brand1' "
    f"THEN total_sales ELSE 0 END) b FROM {FACT} JOIN dim_product USING (product_id) GROUP BY 1 ORDER BY 1",
    f"SELECT brand, SUM(total_sales) s FROM {FACT} JOIN dim_product USING (product_id) "
    "GROUP BY brand ORDER BY s DESC NULLS LAST LIMIT 1",
    f"WITH y AS (SELECT year, SUM(total_sales) s FROM {FACT} GROUP BY year) SELECT a.year, "
    "ROUND((a.s - b.s) / NULLIF(b.s, 0) * 100, 2) g FROM y a LEFT JOIN y b ON a.year = b.year + 1",
    "WITH i AS (SELECT category_id, SUM(total_sales) s FROM fact_internal_sales GROUP BY 1), c AS "
    "(SELECT category_id, SUM(competitor_sales) s FROM fact_competitor_market GROUP BY 1) "
    "SELECT category, i.s, c.s, i.s / (i.s + c.s) FROM i JOIN c USING (category_id) JOIN dim_category "
    "USING (category_id)",
    "SELECT (SELECT SUM(total_sales) FROM fact_internal_sales) / (SELECT SUM(competitor_sales) "
    "FROM fact_competitor_market) AS r",
    f"SELECT quarter, COUNT(DISTINCT week_number), COUNT(*) FILTER (WHERE is_imputed) FROM {FACT} "
    "GROUP BY quarter HAVING COUNT(*) > 1",
    f"SELECT * FROM (SELECT brand, year, RANK() OVER (PARTITION BY year ORDER BY SUM(total_sales) DESC) r "
    f"FROM {FACT} JOIN dim_product USING (product_id) GROUP BY ALL) WHERE r <= 2",
    "SELECT brand FROM dim_product WHERE product_id IN (SELECT product_id FROM fact_internal_sales) "
    "UNION SELECT category FROM dim_category EXCEPT SELECT 'x'",
    "SELECT DISTINCT retailer FROM dim_retailer r WHERE EXISTS (SELECT 1 FROM fact_internal_sales f "
    "WHERE f.retailer_id = r.retailer_id)",
    f"SELECT year, month, SUM(total_sales) FROM {FACT} GROUP BY ROLLUP (year, month)",
    f"SELECT date_trunc('month', week_start) m, LAG(SUM(total_sales)) OVER (ORDER BY date_trunc('month', "
    f"week_start)) p FROM {FACT} GROUP BY 1",
    "SELECT * FROM (SELECT category_id, is_imputed, volume FROM fact_internal_sales) "
    "PIVOT (SUM(volume) FOR is_imputed IN (true AS yes, false AS no))",
    "SELECT retailer, v FROM dim_retailer LATERAL VIEW explode(split(retailer, 'o')) x AS v",
    "SELECT x FROM (VALUES (1), (2)) q(x) JOIN dim_category ON category_id = x",
    "SELECT COALESCE(UPPER(TRIM(brand)), 'none') || '-' || LPAD(CAST(product_id AS STRING), 4, '0'), "
    "CEIL(product_id / 2.0), TRY_CAST(sku_id AS INT), REGEXP_EXTRACT(sku_id, '([0-9]+)', 1) FROM dim_product",
    "SELECT percentile_approx(total_sales, 0.5), median(volume), MAX_BY(product_id, volume), "
    "AVG(volume), STDDEV(volume) FROM fact_internal_sales",
]


@pytest.mark.parametrize("n", range(len(SHAPES)))
def test_question_shapes_run(spark, star, n):
    run_sql(spark, SHAPES[n], star).collect()


HOST = "reflect('java.lang.System', 'getProperty', 'user.home')"
REFUSED = [
    f"SELECT {HOST}",
    "SELECT java_method('java.lang.System', 'exit', 0)",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'x')",
    f"SELECT max({HOST}) OVER () FROM dim_time",
    f"SELECT nvl({HOST}, '') FROM dim_time",
    f"SELECT category FROM dim_category ORDER BY {HOST}",
    f"SELECT category FROM dim_category WHERE category = (SELECT {HOST})",
    f"SELECT transform(array(1), x -> length({HOST}))",
    "SELECT * FROM parquet.`{path}`",
    "WITH dim_time AS (SELECT * FROM parquet.`{path}`) SELECT * FROM dim_time",
    "SELECT * FROM dim_category WHERE category_id IN (SELECT n FROM parquet.`{path}`)",
    "SELECT (SELECT max(n) FROM parquet.`{path}`)",
    "SELECT * FROM (SELECT * FROM (SELECT * FROM text.`{path}`))",
    "SELECT * FROM elsewhere", "SELECT * FROM fact_weekly_summary",
    "SELECT input_file_name() FROM dim_time",
    "SELECT transform(category) USING 'cat' AS (x) FROM dim_category",
    "SELECT from_protobuf(binary('a'), 'm', '{path}')",
    "SELECT homemade(category) FROM dim_category",
    "SELECT * FROM range(5)",
    "SELECT raise_error('x')",
    "FROM dim_time INSERT INTO dim_category SELECT date_id, 'x'",
    "INSERT INTO dim_category VALUES (9, 'x')", "DROP VIEW dim_time", "SET x = 1", "SHOW TABLES",
    "DESCRIBE dim_time", "EXPLAIN SELECT 1", "CACHE TABLE dim_time", "BEGIN SELECT 1; END",
    "EXECUTE IMMEDIATE 'SELECT 1'", "ADD JAR '/x'", "CREATE TABLE z AS SELECT 1",
    "SELECT 1; SELECT 2", "SELECT 1) q CROSS JOIN (SELECT 2", "SELEKT nonsense", ""]


def test_everything_else_is_refused(spark, star, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.range(3).toDF("n").write.parquet(path)
    spark.range(3).createOrReplaceTempView("elsewhere")
    spark.udf.register("homemade", lambda x: x)
    for sql in REFUSED:
        with pytest.raises(NotAQuery):
            run_sql(spark, sql.replace("{path}", path), star)


def test_without_a_star_the_views_of_the_session_may_be_read(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("elsewhere")
    assert check_query(spark, " SELECT * FROM elsewhere ; ") == "SELECT * FROM elsewhere"
    with pytest.raises(NotAQuery):
        check_query(spark, "SELECT * FROM elsewhere", ["dim_time"])

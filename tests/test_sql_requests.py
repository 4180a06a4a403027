import pytest

from shelfwise.plans.requests import answer_revenue_questions
from shelfwise.plans.sqlapi import NotAQuery, check_query, run_sql


def test_read_only_check(spark):
    spark.range(3).createOrReplaceTempView("t_numbers")
    assert run_sql(spark, "SELECT id FROM t_numbers WHERE id > 0;").count() == 2
    assert run_sql(spark, "WITH a AS (SELECT id FROM t_numbers) SELECT * FROM a -- note").count() == 3
    assert run_sql(spark, "SELECT 'a;b' AS s FROM t_numbers").count() == 3
    for bad in ["INSERT INTO t_numbers SELECT 5", "DROP VIEW t_numbers", "SET x = 1",
                "CREATE TABLE z AS SELECT 1", "SELECT 1; SELECT 2", "SELEKT nonsense"]:
        with pytest.raises(NotAQuery):
            check_query(spark, bad)
    assert spark.table("t_numbers").count() == 3


def test_questions(spark):
    import datetime as dt

    from shelfwise.functions.dates import time_attributes
    from shelfwise.operators.star import build_star

    internal = spark.createDataFrame([
        ("S1", "Brand#1", "C", "R", "v", 1.0, 10.0, False, dt.date(2024, 1, 1)),
        ("S2", "Brand#13", "C", "R", "v", 1.0, 5.0, False, dt.date(2024, 1, 1)),
        ("S2", "Brand#13", "C", "R", "v", 1.0, 7.0, False, dt.date(2023, 1, 2)),
    ], "sku_id string, brand string, category string, retailer string, variant string, "
       "volume double, total_sales double, is_imputed boolean, week_start date")
    comp = internal.selectExpr("category", "retailer", "1L AS competitor_volume",
                               "1.0 AS competitor_sales", "week_start").limit(0)
    star = build_star(time_attributes(internal), time_attributes(comp), materialize=False)
    qs = spark.createDataFrame([
        ("What was the total revenue for Brand#13 in 2024?",),
        ("total revenue of brand#1",),
        ("Total revenue in 2023",),
        ("What is the total revenue?",),
        ("What was the total revenue in 2031?",),
        ("How did Brand#1 do in 2024?",),
    ], "question string")
    got = {r.question: (r.year, r.brand, r.status, r.total_revenue)
           for r in answer_revenue_questions(star, qs).collect()}
    assert got["What was the total revenue for Brand#13 in 2024?"] == (2024, "Brand#13", "answered", 5.0)
    assert got["total revenue of brand#1"] == (None, "Brand#1", "answered", 10.0)
    assert got["Total revenue in 2023"] == (2023, None, "answered", 7.0)
    assert got["What is the total revenue?"] == (None, None, "answered", 22.0)
    assert got["What was the total revenue in 2031?"] == (2031, None, "answered", None)
    assert got["How did Brand#1 do in 2024?"] == (2024, "Brand#1", "not_answered", None)

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.functions.dates import parse_date, time_attributes
from shelfwise.functions.numeric import impute_sales, pct_change, ratio_pct, try_double, try_long
from shelfwise.functions.text import clean_sku, extract_year, strip_ws, typo


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_sku_edge_cases(spark):
    got = col1(spark, [None, "SKU-1234", "sku a1234", " SKU 12345 ", "SKU-1Z34", "unassigned",
                       "abc", "\tsku-0007\n"], clean_sku)
    assert got == [None, "SKU-1234", "SKU-1234", "SKU-1234", "SKU-1034", "UN-SSIGNED",
                   "-BC", "SKU-0007"]


def test_strip_is_python_strip(spark):
    # every code point of white space, and some that are none
    vals = ["  a ", "\t\nb\r\x0b\x0c", "c"] + [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3100)
                                              if chr(c).isspace() or c % 97 == 0]
    assert col1(spark, vals, strip_ws) == [v.strip() for v in vals]


def test_typo_replaces_one_char(spark):
    assert col1(spark, ["Brand#13"], lambda c: typo(c, 2, "x")) == ["Bxand#13"]
    assert col1(spark, ["abc"], lambda c: typo(c, 3, "z")) == ["abz"]


def test_try_double(spark):
    got = col1(spark, [None, "", "abc", " 12.5 ", "nan", "Infinity", "1e3", "-4"], try_double)
    assert got == [None, None, None, 12.5, None, None, 1000.0, -4.0]
    got = col1(spark, ["100D", "12f", "1e400", "0x10", "1_0", ".5", "5.", "+1", "\u00a07"], try_double)
    assert got == [None, None, None, None, 10.0, 0.5, 5.0, 1.0, 7.0]


def test_try_long(spark):
    got = col1(spark, ["12", "-3.7", "1e30", "9223372036854775807", "99999999999999999999", "x", None],
               try_long)
    assert got == [12, -3, None, 9223372036854775807, None, None, None]


def test_impute_sales_rules(spark):
    rows = [("10.50", 2.0, 3.0), (None, 2.0, 3.25), ("", 4.0, 1.1), ("n/a", 3.0, 2.0),
            (None, None, 3.0), ("", 2.0, None)]
    df = spark.createDataFrame(rows, "t string, v double, p double")
    total, flag = impute_sales("t", "v", "p")
    got = [tuple(r) for r in df.select(total, flag).collect()]
    assert got == [(10.5, False), (6.5, True), (4.4, True), (6.0, True), (None, False),
                   (None, False)]


def test_imputation_is_at_full_scale(spark):
    rows = [(None, 1000.0, 0.125), ("100D", 3.0, 0.335), (None, 1e17, 2.0), (None, 1e200, 1e200)]
    df = spark.createDataFrame(rows, "t string, v double, p double")
    total, flag = impute_sales("t", "v", "p")
    got = [tuple(r) for r in df.select(total, flag).collect()]
    assert got == [(125.0, True), (3 * 0.335, True), (2e17, True), (None, False)]


def test_sku_width_is_a_parameter(spark):
    assert col1(spark, ["SKU-1234567", "sku 12"], lambda c: clean_sku(c, 6)) == ["SKU-123456", "SKU 12"]


def test_time_attributes_year_end(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2021, 1, 3),)], "week_start date")
    r = time_attributes(df).orderBy("week_start").collect()
    assert (r[0].year, r[0].week_number, r[0].iso_year) == (2021, 53, 2020)
    assert (r[1].year, r[1].month, r[1].quarter, r[1].week_number, r[1].iso_year) == \
        (2024, 12, 4, 1, 2025)


def test_parse_date_formats(spark):
    got = col1(spark, ["2024-03-04", "2024/03/04", " 2024-03-04 ", "03/04/2024", "bad", None],
               parse_date)
    d = dt.date(2024, 3, 4)
    assert got == [d, d, d, d, None, None]
    got = col1(spark, ["2024-03-04T10:11:12", "2024-03-04 00:00:00.000", "2024-3-4", "03-04-2024",
                       "2024-03-04T10:11:12.5Z", "20240304", "4 Mar 2024", "March 4, 2024",
                       "2024/3/4", "\u00a02024-03-04"], parse_date)
    assert got == [d] * 10
    assert col1(spark, ["12:30", "2024-13-40", "2024-03-04x", "", "4"], parse_date) == [None] * 5


def test_ratios_null_on_zero(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 4.0), (None, 4.0), (0.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(pct_change("a", "b"), ratio_pct("a", "b")).collect()]
    assert got == [(None, None), (25.0, 125.0), (None, None), (None, None)]


def test_extract_year(spark):
    got = col1(spark, ["revenue in 2024?", "in 1998", "x2024y", "2019 and 2024", None],
               extract_year)
    assert got == [2024, None, None, 2019, None]

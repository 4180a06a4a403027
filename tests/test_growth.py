"""Steps whose cost a line must not grow: texts are searched once, only texts of
a layout's shape are tried, and lines are not shuffled to meet small tables."""

import datetime as dt
import threading

from pyspark.sql import functions as F

from shelfwise.functions.dates import ISO, WEEK_FORMATS, layout_shape, parse_date
from shelfwise.functions.numeric import finite, try_double
from shelfwise.functions.text import clean_sku, strip_ws
from shelfwise.operators import star as S
from shelfwise.plans import catalog as C
from shelfwise.sources.feeds import read_competitor_csv, read_internal_csv, write_csv
from shelfwise.sources.sales_feed import raw_competitor_feed, raw_internal_feed, sales_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_searched_once(spark):
    df = spark.createDataFrame([("1_0",), ("1e400",), ("-1e400",), ("x",), (None,), ("-.5",)], "t string")
    df = spark.createDataFrame(df.rdd, df.schema)      # no local relation: the plan keeps its steps
    for c in (try_double("t"), clean_sku("t")):
        assert plan(df.select(c.alias("v"))).lower().count("regexp_extract(") == 1
        assert "RLIKE" not in plan(df.select(c.alias("v")))
    assert [r.v for r in df.select(try_double("t").alias("v")).collect()] == [
        10.0, None, None, None, None, -0.5]


def test_sku_codes_and_finite_numbers(spark):
    df = spark.createDataFrame([(" sku a12345", 1.5), ("SKU-Z", float("nan")), (None, float("inf")),
                                ("", None), ("b", -0.0)], "t string, v double")
    got = [(r.s, r.v) for r in df.select(clean_sku("t").alias("s"), finite("v").alias("v")).collect()]
    assert got == [("SKU-1234", 1.5), ("SKU-0", None), (None, None), ("", None), ("B", 0.0)]


def test_only_texts_of_the_shape_are_tried(spark):
    tried = plan(spark.createDataFrame(spark.sparkContext.parallelize([("x",)]), "t string")
                 .select(parse_date("t")))
    assert tried.count("RLIKE") >= len(WEEK_FORMATS)


def test_shapes_lose_no_date(spark):
    days = [dt.datetime(2024, 1, 5), dt.datetime(1998, 12, 31), dt.datetime(2024, 9, 30, 7, 8, 9)]
    marks = spark.createDataFrame([(d,) for d in days], "d timestamp")
    texts = None
    for f in WEEK_FORMATS:
        # every layout's own texts, other cases, a sign, a tail, and line breaks inside
        t = F.date_format("d", f)
        part = marks.select(F.explode(F.array(
            t, F.upper(t), F.lower(t), F.concat(F.lit("+"), t), F.concat(F.lit("-"), t),
            F.concat(F.lit(" "), t, F.lit("\n")), F.concat(t, F.lit("x")),
            F.replace(t, F.lit(" "), F.lit("\n")), F.replace(t, F.lit("/"), F.lit("//")))).alias("t"))
        texts = part if texts is None else texts.unionByName(part)
    odd = ["2024-1-5", "2024-01-05T10:00:00Z", "2024-02-30", "20240105", "+20240105", "99999999", "",
           "week unknown", "5 sept 2024", "May 5, 2024", "12345678901234567890", "٢٠٢٤/1/5", None]
    texts = texts.unionByName(spark.createDataFrame([(x,) for x in odd], "t string")).distinct()
    s = strip_ws("t")
    plain = F.coalesce(F.when(s.rlike(ISO), s).try_cast("timestamp"),
                       *[F.try_to_timestamp(s, F.lit(f)) for f in WEEK_FORMATS]).cast("date")
    # as text: Python has no dates before the year 1
    rows = texts.select("t", parse_date("t").cast("string").alias("got"),
                        plain.cast("string").alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == []
    assert sum(r.got is not None for r in rows) > 40


def test_other_layouts_are_tried_on_every_text(spark):
    assert layout_shape("yyyy-MM-dd'T'HH") is None and layout_shape("EEE d/M/yyyy") is None
    df = spark.createDataFrame([("Fri 5/1/2024",), ("2024w1",)], "t string")
    got = df.select(parse_date("t", ["yyyy'w'M"]).alias("d")).collect()
    assert [r.d for r in got] == [None, dt.date(2024, 1, 1)]


def test_lines_are_not_shuffled_to_meet_small_tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    day = dt.datetime(1998, 3, 4)
    put("region", [(1, "AMERICA"), (2, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(1, "A", 1), (2, "B", 2)], "n_nationkey int, n_name string, n_regionkey int")
    # a key in both regions, and one twice
    put("supplier", [(n, 1 + n % 2) for n in range(50)] + [(3, 2), (2, 1), (None, 1), (60, None)],
        "s_suppkey long, s_nationkey int")
    put("customer", [(n, "M") for n in range(50)] + [(None, "N")], "c_custkey long, c_mktsegment string")
    put("orders", [(n, n % 40) for n in range(200)] + [(7, 7), (None, 1), (300, None)],
        "o_orderkey long, o_custkey long")
    put("part", [(n, "red bolt", "Brand#1", "PROMO", 10.0) for n in range(20)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double")
    lines = [(n % 200, n % 20, n % 50, n, 2.0 + n, n * 1.01, day) for n in range(4000)] + [
        (None, 1, 1, 1, 1.0, 1.0, day), (1, None, 1, 1, 1.0, 1.0, day), (1, 1, None, 1, 1.0, 1.0, day),
        (300, 1, 1, 1, 1.0, 1.0, day), (1, 1, 60, 1, 1.0, 1.0, day)]
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                           "l_quantity double, l_extendedprice double, l_shipdate timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6k")
    try:
        got = sales_lines(spark, str(tmp_path))
        assert "SortMergeJoin" not in plan(got)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # suppliers 2 and 3 join themselves: 2 rows in the region meet 2, one of two gives 2
    own = {n: (n % 2 == 0) for n in range(50)} | {60: False}
    times = {n: 1 for n in own} | {2: 4 if own[2] else 2, 3: 2}
    want = []
    for o, p, s, *_ in lines:
        if None not in (o, p, s) and o < 300:
            want += [(o, p, own[s])] * (times[s] * (2 if o == 7 else 1))
    assert sorted((r.l_orderkey, r.p_partkey, r.is_internal) for r in rows) == sorted(want)
    assert {(r.week_start, r.retailer, r.variant, r.category) for r in rows} == {
        (dt.date(1998, 3, 2), "M", "bolt", "PROMO")}


def sales(spark):
    """Lines as ``sales_lines`` gives them, with nulls and a repeated one."""
    rows = [(n, n % 7, n % 30, 1.0 + n, 2.5, n * 1.5, dt.date(1998, 3, 2) + dt.timedelta(weeks=n % 5),
             "PROMO" if n % 2 else None, f"Brand#{n % 4}", "bolt", "M", n % 5 == 0) for n in range(200)]
    rows += [rows[5], rows[6], (3, None, None, None, None, None, None, None, None, None, None, True)]
    return spark.createDataFrame(rows, (
        "l_orderkey long, l_linenumber int, p_partkey long, volume double, unit_price double, "
        "amount double, week_start date, category string, brand string, variant string, "
        "retailer string, is_internal boolean")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_competitor_lines_are_written_without_products(spark, monkeypatch):
    staged, stage = {}, C.stage
    monkeypatch.setattr(C, "sales_lines", lambda *_: sales(spark))
    monkeypatch.setattr(C, "aliases_for", lambda *_: {})
    monkeypatch.setattr(C, "_once", lambda cache, spark, sf_dir, make: make())
    monkeypatch.setattr(C, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    paths = C.land(spark, "none")
    lines = staged["sales-lines"]
    assert lines.where("NOT is_internal AND (p_partkey IS NOT NULL OR brand IS NOT NULL)").isEmpty()
    assert lines.count() == sales(spark).count()
    # the feeds are those of the whole lines
    plain = {k: C.staging_path(spark, f"plain-{k}") for k in ("internal", "competitor")}
    write_csv(raw_internal_feed(sales(spark)), plain["internal"])
    write_csv(raw_competitor_feed(sales(spark)), plain["competitor"])
    C.ragged_drop(sales(spark)).write.mode("append").text(plain["internal"])
    for read, k in ((read_internal_csv, "internal"), (read_competitor_csv, "competitor")):
        assert as_rows(read(spark, paths[k])) == as_rows(read(spark, plain[k])) != []


def test_a_feed_is_cut_into_records_once_for_both_changed_ones(spark, tmp_path, monkeypatch):
    write_csv(raw_internal_feed(sales(spark)), f"{tmp_path}/feed")
    written, built = [], []
    monkeypatch.setattr(C, "land", lambda *_: {"internal": f"{tmp_path}/feed", "competitor": "", "aliases": {}})
    monkeypatch.setattr(C, "_once", lambda cache, spark, sf_dir, make: make())
    monkeypatch.setattr(C, "write_csv", lambda df, path: written.append(df))
    monkeypatch.setattr(C, "rebuild_from_csv", lambda spark, feed, *a, **k: built.append(feed) or {"star": {}})
    C.chain(spark, "none")
    assert len(built) == 3 and len(written) == 2
    assert all("csv" not in plan(df).lower() for df in written)
    whole = raw_internal_feed(sales(spark)).count()
    late = written[0].where(F.col("Reported_SKU").rlike(C.LATE_SKU)).count()
    assert late == 0 < written[0].count() < whole
    assert written[1].where(F.col("Week_Start").like(C.TAKEN_BACK)).count() == 0 < written[1].count() < whole


def test_both_facts_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    both, write = threading.Barrier(2, timeout=120), S._write_fact

    def met(*args):
        both.wait()
        write(*args)

    monkeypatch.setattr(S, "_write_fact", met)
    week = dt.date(2024, 1, 1)
    internal = C.time_attributes(spark.createDataFrame(
        [("SKU-1", "A", "Lamps", "Quay", "Raw", 1.0, 2.0, False, week)],
        "sku_id string, brand string, category string, retailer string, variant string, "
        "volume double, total_sales double, is_imputed boolean, week_start date"))
    rival = C.time_attributes(spark.createDataFrame(
        [("Tiles", "Quay", 3, 7.0, week)], "category string, retailer string, "
        "competitor_volume bigint, competitor_sales double, week_start date"))
    S.write_star(S.build_star(internal, rival), str(tmp_path / "star"))
    star = S.read_star(spark, str(tmp_path / "star"))
    assert [star[t].count() for t in S.FACT_COLS] == [1, 1]

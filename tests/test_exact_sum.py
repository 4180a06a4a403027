import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import exact_sum as X
from shelfwise.functions.dates import time_attributes
from shelfwise.operators import metrics as M
from shelfwise.operators import trend as T
from shelfwise.operators.star import build_star, read_star, write_star

NAN, INF = float("nan"), float("inf")


def groups():
    rng = random.Random(1)
    out = [[1e23, 5.0, 4e-7], [4e-7, 5.0], [0.1] * 10, [1e300, 1.0, -1e300], [5e-324] * 3 + [1e-310],
           [1.7e308, -1.7e308, 3.3], [None, None], [0.0, -0.0], [1e22, 1e22, -1e22, 0.01], [1e23],
           [INF, 2.0, NAN], [2.0 ** 70, 1.0, -(2.0 ** 70)], [2.0 ** 53, 1.0, 1.0], [1e16, 1.0, -1e16]]
    out += [[rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(40)] for _ in range(40)]
    out += [[rng.uniform(-1, 1) * 2.0 ** rng.randint(-1070, 1000) for _ in range(40)] for _ in range(40)]
    out += [[round(rng.uniform(0, 1e5), 2) for _ in range(100)] for _ in range(20)]
    for _ in range(30):         # all but a little is taken back
        g = [1e-9]
        for _ in range(20):
            a = rng.uniform(-1, 1) * 10 ** rng.randint(-5, 40)
            g += [a, -a]
        rng.shuffle(g)
        out.append(g)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_equal_fsum_however_the_rows_are_dealt(spark, parts):
    of = groups()
    df = spark.createDataFrame([(i, x) for i, g in enumerate(of) for x in g], "g int, x double")
    got = {r.g: r.t for r in X.exact_sums(df.repartition(parts), ["g"], {"t": X.part("x")}).collect()}
    for i, g in enumerate(of):
        finite = [x for x in g if x is not None and math.isfinite(x)]
        assert got[i] == (math.fsum(finite) if finite else None), g


def test_several_sums_and_coarser_groups(spark):
    rows = [(i % 3, i % 2, [0.1, 1e23, 4e-7, None][i % 4], i) for i in range(48)]
    df = spark.createDataFrame(rows, "a int, b int, x double, n long")
    sums = {"all": X.part("x"), "odd": X.kept_if(F.col("b") == 1, X.part("x"))}
    fine = X.cells(df, ["a", "b"], sums, {"n": F.col("n")})
    got = {(r.a, r.b, r.level_id): (r["all"], r.odd, r.n) for r in X.grouping_sets(
        fine, ["a", "b"], [["a", "b"], ["a"], ["b"], []], ["all", "odd"], ["n"]).collect()}

    def of(test):
        mine = [r for r in rows if test(r)]
        total = lambda xs: math.fsum(xs) if xs else None
        return (total([r[2] for r in mine if r[2] is not None]),
                total([r[2] for r in mine if r[2] is not None and r[1] == 1]), sum(r[3] for r in mine))

    want = {(a, b, 0): of(lambda r: r[:2] == (a, b)) for a in range(3) for b in range(2)}
    want |= {(a, None, 1): of(lambda r: r[0] == a) for a in range(3)}
    want |= {(None, b, 2): of(lambda r: r[1] == b) for b in range(2)}
    want[None, None, 3] = of(lambda r: True)
    assert got == want
    empty = X.exact_sums(df.where("a > 9"), [], sums).collect()
    assert [tuple(r) for r in empty] == [(None, None)]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    amounts = [1e23, 5.0, 4e-7, 0.25, None, 1e300, -1e300, 12.345]
    internal = spark.createDataFrame([
        (f"S{i}", f"B{i % 2}", "C", "R", "v", 1.0, x, False, dt.date(2024, 1, 1) + dt.timedelta(7 * (i % 3)))
        for i, x in enumerate(amounts)],
        "sku_id string, brand string, category string, retailer string, variant string, "
        "volume double, total_sales double, is_imputed boolean, week_start date")
    rival = internal.selectExpr("category", "retailer", "1L AS competitor_volume",
                                "total_sales AS competitor_sales", "week_start")
    path = str(tmp_path_factory.mktemp("exact") / "star")
    write_star(build_star(time_attributes(internal), time_attributes(rival)), path)
    return read_star(spark, path), [x for x in amounts if x is not None]


def test_no_amount_is_lost_between_fact_and_metric(star):
    star, amounts = star
    want = math.fsum(amounts)
    assert M.total_revenue(star).first()[0] == want                     # the weekly summary
    lines = M.internal_lines(star, use_summary=False)
    assert M.revenue_of(lines).first()[0] == want                       # the fact
    s = M.market_share(star).first()
    assert (s.internal_sales, s.competitor_sales) == (want, want)
    assert s.total_market_sales == math.fsum(amounts * 2) and s.market_share_percent == 50.0
    rolled = {r.level_id: r for r in T.rollup_revenue(star, ["year", "brand"]).where("brand is null").collect()}
    assert rolled[3].total_revenue == want and rolled[1].total_volume == 8.0


def test_roll_up_copies_no_line(star):
    star, _ = star
    plan = T.rollup_revenue(star, ["category", "sku_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan

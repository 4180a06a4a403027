"""Builds of a written star: stable ids, changed weeks, retention."""

import datetime as dt

import pytest

from shelfwise.functions.dates import time_attributes
from shelfwise.operators import builds as B
from shelfwise.operators import metrics as M
from shelfwise.operators.keys import stable_key
from shelfwise.operators.star import build_star, read_star, write_star

SCHEMA = ("sku_id string, brand string, category string, retailer string, variant string, "
          "volume double, total_sales double, is_imputed boolean, week_start date")
WEEKS = [dt.date(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(6)]


def lines(skus="bdf", weeks=WEEKS, sales=10.0):
    return [(f"SKU-{s}", f"Brand {s}", "Lamps", "Quay", "Raw", 1.0, sales, False, w)
            for s in skus for w in weeks] + [(None, "Brand b", "Lamps", "Quay", "Raw", 1.0, 5.0,
                                              False, weeks[0])]


def rebuild(spark, path, rows, keep=2, min_age=0.0, rival=((WEEKS[0], 7.0),)):
    internal = time_attributes(spark.createDataFrame(rows, SCHEMA))
    competitor = time_attributes(spark.createDataFrame(
        [("Tiles", "Quay", 3, s, w) for w, s in rival],
        "category string, retailer string, competitor_volume bigint, competitor_sales double, "
        "week_start date"))
    base = B.current(spark, path)
    known = B.read_keys(spark, path, base) if base else None
    write_star(build_star(internal, competitor, known=known), path, base=base, keep=keep,
               min_age=min_age)
    return read_star(spark, path)


def products(star):
    return {r.sku_id: r.product_id for r in star["dim_product"].collect()}


def written(path, build, fact="fact_internal_sales"):
    return len(list((path / build / fact).glob("date_id=*")))


def test_members_keep_their_ids(spark, tmp_path):
    path = str(tmp_path / "star")
    assert products(rebuild(spark, path, lines("bdf"))) == {
        None: 1, "SKU-b": 2, "SKU-d": 3, "SKU-f": 4}
    # a and c come, d goes; the week before all others comes late
    early = dt.date(2023, 12, 25)
    star = rebuild(spark, path, lines("abcf", [early, *WEEKS]))
    assert products(star) == {None: 1, "SKU-b": 2, "SKU-f": 4, "SKU-a": 5, "SKU-c": 6}
    weeks = {r.week_start: r.date_id for r in star["dim_time"].collect()}
    assert weeks[early] == 7 and [weeks[w] for w in WEEKS] == list(range(1, 7))
    # d comes back and has its id; nobody else ever got it
    assert products(rebuild(spark, path, lines("abcdefg"))) == {
        None: 1, "SKU-b": 2, "SKU-d": 3, "SKU-f": 4, "SKU-a": 5, "SKU-c": 6, "SKU-e": 7, "SKU-g": 8}


def test_stable_key_treats_null_as_a_value(spark):
    known = spark.createDataFrame([(4, None, "x"), (9, "a", None)], "id long, k string, l string")
    got = stable_key(spark.createDataFrame([("a", None), (None, "x"), (None, None), ("a", "b")],
                                           "k string, l string"), known, ["k", "l"], "id")
    assert {(r.k, r.l): r.id for r in got.collect()} == {
        (None, "x"): 4, ("a", None): 9, (None, None): 10, ("a", "b"): 11}
    none = known.limit(0)
    assert [r.id for r in stable_key(known.select("k", "l"), none, ["k", "l"], "id")
            .orderBy("id").collect()] == [1, 2]


def test_only_changed_weeks_are_written(spark, tmp_path):
    path = tmp_path / "star"
    rebuild(spark, str(path), lines())
    first = B.current(spark, str(path))
    assert written(path, first) == len(WEEKS)
    changed = [r[:6] + (99.0,) + r[7:] if r[8] == WEEKS[2] and r[0] == "SKU-b" else r
               for r in lines()][::-1]                    # the order of lines means nothing
    star = rebuild(spark, str(path), changed)
    second = B.current(spark, str(path))
    assert (written(path, second), written(path, second, "fact_competitor_market")) == (1, 0)
    total = sum(r[6] for r in changed if r[0])
    assert M.total_revenue(star).first()[0] == total
    assert M.total_revenue({k: v for k, v in star.items() if k != "fact_weekly_summary"}
                           ).first()[0] == total
    assert star["fact_internal_sales"].count() == 3 * len(WEEKS)
    # a repeated line is a change, a week goes, the others are not written
    star = rebuild(spark, str(path), [r for r in changed if r[8] != WEEKS[5]] + changed[-2:-1])
    assert written(path, B.current(spark, str(path))) == 1
    assert star["fact_internal_sales"].count() == 3 * (len(WEEKS) - 1) + 1
    assert M.total_revenue(star).first()[0] == total - 30.0 + changed[-2][6]
    # weeks of the first build are still read, so it stays
    assert first in [n for n, _ in B.complete(spark, str(path))]


def test_the_same_star_as_built_at_once(spark, tmp_path):
    step, once = str(tmp_path / "step"), str(tmp_path / "once")
    for weeks in (WEEKS[:4], WEEKS):
        a = rebuild(spark, step, lines("bdf", weeks))
    b = rebuild(spark, once, lines("bdf", WEEKS))
    for t in b:
        cols = sorted(b[t].columns)
        assert sorted(map(tuple, a[t].select(cols).collect()), key=repr) == sorted(
            map(tuple, b[t].select(cols).collect()), key=repr), t


def test_facts_spread_over_many_builds_are_written_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "MERGE_AFTER", 2)
    path = tmp_path / "star"
    for n in range(3):
        rebuild(spark, str(path), lines(weeks=WEEKS[:n + 2]), rival=[])
    assert B.blocks(spark, str(path), B.current(spark, str(path))) == 1
    assert written(path, B.current(spark, str(path))) == 4


def test_a_star_read_before_answers_after(spark, tmp_path):
    path = str(tmp_path / "star")
    old = rebuild(spark, path, lines("b", sales=1.0))
    name = B.current(spark, path)
    rebuild(spark, path, lines("bc", sales=2.0))
    assert M.total_revenue(old).first()[0] == len(WEEKS)
    assert M.total_revenue(read_star(spark, path, name)).first()[0] == len(WEEKS)
    rebuild(spark, path, lines("bc", sales=3.0), min_age=3600)     # too young to go
    assert M.total_revenue(old).first()[0] == len(WEEKS)
    rebuild(spark, path, lines("bc", sales=4.0), keep=1, rival=[(WEEKS[1], 1.0)])
    assert [n for n, _ in B.complete(spark, path)] == [B.current(spark, path)]
    with pytest.raises(Exception):
        M.total_revenue(read_star(spark, path, name)).first()
    with pytest.raises(ValueError):
        B.expire(spark, path, keep=0)


def test_two_writers_leave_one_whole_build(spark, tmp_path):
    path = str(tmp_path / "star")
    rebuild(spark, path, lines("b", sales=1.0))
    base = B.current(spark, path)
    known = B.read_keys(spark, path, base)
    rows = {s: time_attributes(spark.createDataFrame(lines(s, sales=9.0), SCHEMA)) for s in ("bx", "by")}
    rival = time_attributes(spark.createDataFrame(
        [], "category string, retailer string, competitor_volume bigint, competitor_sales double, "
        "week_start date"))
    for s in ("bx", "by"):                 # both began from the same build
        write_star(build_star(rows[s], rival, known=known), path, base=base, keep=2)
    star = read_star(spark, path)
    assert products(star) == {None: 1, "SKU-b": 2, "SKU-y": 3}
    assert M.total_revenue(star).first()[0] == 2 * 9.0 * len(WEEKS)
    assert star["fact_competitor_market"].count() == 0
    assert products(rebuild(spark, path, lines("bxy"))) == {
        None: 1, "SKU-b": 2, "SKU-y": 3, "SKU-x": 4}

import csv
import random

import pytest

from shelfwise.functions.numeric import try_double
from shelfwise.operators.quality import quality_counts
from shelfwise.plans.rebuild import rebuild_from_csv
from shelfwise.sources import feeds as R
from test_io_streaming import INTERNAL, write_inputs

NAMES = R.COMPETITOR_COLUMNS


def field(rng):
    return "".join(rng.choice(["a", "b ", ",", '"', "\n", "\r\n", "é", "x", "|", "'"])
                   for _ in range(rng.randint(1, 5))) + "z"


def write(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(NAMES)
        w.writerows(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_equal_a_plain_csv_reader(spark, tmp_path, seed):
    rng = random.Random(seed)
    want = []
    for n in range(4):
        rows = []
        for _ in range(40):
            width = rng.choice([5] * 8 + [2, 4, 6, 7])
            plain = n == 0      # one file stays without a quoted line break
            rows.append(["w" + (str(rng.random()) if plain else field(rng)) for _ in range(width)])
        path = tmp_path / f"drop {n}.csv"
        write(path, rows)
        with open(path, newline="") as f:
            want += list(csv.reader(f))[1:]
    got = R.read_records(spark, str(tmp_path), "competitor")
    assert len(R.quoted_break_files(spark, str(tmp_path))) == 3
    state = lambda r: "whole" if len(r) == 5 else "short" if len(r) < 5 else "surplus"
    assert (sorted((r.record_state, *[r[c] or "" for c in NAMES]) for r in got.collect())
            == sorted((state(r), *[*r, "", "", "", ""][:5]) for r in want))
    kept = [r for r in want if len(r) <= 5]
    feed = R.accepted(got, "competitor")
    assert feed.count() == len(kept)
    # the same whatever columns are asked for
    assert feed.select("Week_Start").count() == len(kept)
    assert (sorted(r[0] for r in R.read_competitor_csv(spark, str(tmp_path))
                   .select("Reported_Retailer").collect()) == sorted(r[1] for r in kept))
    assert R.refused(got).count() == len(want) - len(kept)


def test_a_quoted_line_break_stays_in_its_field(spark, tmp_path):
    (tmp_path / "c.csv").write_text(",".join(NAMES) + '\n"a\nb",r,1,2,2024-01-01\n')
    (r,) = R.read_competitor_csv(spark, str(tmp_path / "c.csv")).collect()
    assert (r.Reported_Category, r.Reported_Retailer, r.Competitor_Volume) == ("a\nb", "r", 1)


def test_an_open_quote_to_the_end_is_refused(spark, tmp_path):
    (tmp_path / "c.csv").write_text(",".join(NAMES) + '\na,r,1,2,2024-01-01\n"open,r,1,2\n')
    got = R.read_records(spark, str(tmp_path / "c.csv"), "competitor").collect()
    assert [r.record_state for r in got][0] == "whole" and len(got) == 2
    assert got[1].record_state != "whole"


def test_rebuild_counts_and_keeps_what_it_refuses(spark, tmp_path):
    paths = write_inputs(tmp_path)
    with open(tmp_path / "internal.csv", "a") as f:
        f.write('SKU-1111,Lanterna,Lighting,"CornerShop\n",Matte,1,1,2.5,2024-01-08\n'
                "SKU-1112,Lanterna,Lighting\n"
                "SKU-1113,Lanterna,Lighting,CornerShop,Matte,1,1,2.5,2024-01-08,more\n")
    built = rebuild_from_csv(spark, str(tmp_path / "internal.csv"), str(tmp_path / "competitor.csv"),
                             paths, str(tmp_path / "star"))
    n = INTERNAL.count("\n") - 1
    assert built["internal"].count() == n + 2
    q = {(r.check, r.table_name): r.value for r in quality_counts(
        built["star"], built["internal"], built["competitor"], built["records"]).collect()}
    assert q["short_records", "fact_internal_sales"] == 1
    assert q["surplus_records", "fact_internal_sales"] == 1
    assert q["surplus_records", "fact_competitor_market"] == 0
    assert q["row_count", "fact_internal_sales"] == 5       # 4, and the one with the line break
    (r,) = built["refused"]["internal"].collect()
    assert r[0].startswith("SKU-1113") and r[0].endswith("more")


NUMBERS = ["1_000", "1_0.5_0", "1__0", "_1", "1_", "1_.5", "1._5", "1.5_", "1e1_0", "1e_1", "1.", ".5", "._5",
           "+1_2e-0_3", "1_000D", "0x1_0", " 1_0 ", "", "-", "1e5", "1 000"]


def test_numbers_as_python_reads_them(spark):
    def plain(t):
        try:
            return float(t)
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string").select("t", try_double("t").alias("v"))
    assert {r.t: r.v for r in df.collect()} == {t: plain(t) for t in NUMBERS}

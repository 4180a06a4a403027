import pytest
from pyspark.sql import functions as F

from shelfwise.operators import metrics as M
from shelfwise.operators.clean import clean_feeds
from shelfwise.operators.quality import quality_counts, sales_text_audit
from shelfwise.operators.star import read_star, write_star
from shelfwise.plans.rebuild import rebuild_from_csv
from shelfwise.session import stage
from shelfwise.sources.feeds import (CSV_OPTIONS, read_alias_csv, read_competitor_csv,
                                     read_internal_csv, write_clean)
from shelfwise.streaming.weekly_ingest import ingest

# Feeds and alias tables made up for these tests.
INTERNAL = """Reported_SKU,Reported_Brand,Reported_Category,Reported_Retailer,Reported_Variant,Volume,Unit_Price,Total_Sales,Week_Start
SKU A1234,lanterna,lamps,Corner Shop Inc,matte,10,2.5,25.0,2024-01-01
sku-1234,LANTERNA ,Lighting,cornershop,Matte,4,0.125,,2024-01-08T00:00:00
SKU-5678,Crokker,lumen,HarborHall,gloss,3,,n/a,2024/1/8
,Lanterna,Lighting,CornerShop,Matte,1,1,NA,2024-01-08
SKU-9999,Qqqzzz,Timber,HarborHall,Raw,2,1.5,3.0,2023-12-25
SKU-7777,Lanterna,Timber,HarborHall,Raw,1e17,1e20,100D,soon
"""
COMPETITOR = """Reported_Category,Reported_Retailer,Competitor_Volume,Competitor_Sales,Week_Start
Lighting,CornerShop,100,1000.0,2024-01-01
lamps,harborhall,1e30,,2024-01-08
"""
ALIASES = {
    "brand": "alias,canonical\nLanterna,Lanterna\nCroaker,Croaker\ncrokker,Croaker\n",
    "category": "alias,canonical\nLighting,Lighting\nlamps,Lighting\nlumen,Lighting\nTimber,Timber\n",
    "retailer": "alias,canonical\nCornerShop,CornerShop\ncorner shop,CornerShop\nHarborHall,HarborHall\n",
    "variant": "alias,canonical\nMatte,Matte\nGloss,Gloss\nRaw,Raw\n",
}


def write_inputs(tmp_path):
    (tmp_path / "internal.csv").write_text(INTERNAL)
    (tmp_path / "competitor.csv").write_text(COMPETITOR)
    paths = {}
    for k, v in ALIASES.items():
        p = tmp_path / f"alias_{k}.csv"
        p.write_text(v)
        paths[k] = str(p)
    return paths


def test_csv_reader_nulls_and_types(spark, tmp_path):
    write_inputs(tmp_path)
    rows = read_internal_csv(spark, str(tmp_path / "internal.csv")).collect()
    assert rows[1].Total_Sales is None and rows[3].Reported_SKU is None
    assert rows[3].Total_Sales is None and rows[2].Total_Sales is None   # "NA", "n/a"
    assert rows[0].Volume == 10.0 and rows[2].Unit_Price is None
    assert rows[1].Reported_Brand == "LANTERNA "                         # padding is kept
    a = read_alias_csv(spark, str(tmp_path / "alias_category.csv")).orderBy("rank").collect()
    assert [r.alias for r in a] == ["Lighting", "lamps", "lumen", "Timber"]
    c = read_competitor_csv(spark, str(tmp_path / "competitor.csv")).collect()
    assert [r.Competitor_Volume for r in c] == [100, None]               # 1e30 does not fit


def test_columns_are_found_by_name(spark, tmp_path):
    lines = [x.split(",")[::-1] for x in COMPETITOR.strip().split("\n")]
    (tmp_path / "c.csv").write_text("\n".join(",".join(x) for x in lines))
    r = read_competitor_csv(spark, str(tmp_path / "c.csv")).first()
    assert (r.Reported_Category, r.Competitor_Volume, r.Week_Start) == ("Lighting", 100, "2024-01-01")
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_competitor_csv(spark, str(tmp_path / "d.csv"))


def test_alias_order_needs_a_rank_in_several_files(spark, tmp_path):
    folder = tmp_path / "alias"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_text("alias,canonical\na,A\n")
    with pytest.raises(ValueError):
        read_alias_csv(spark, str(folder))


def _rebuilt(spark, tmp_path):
    paths = write_inputs(tmp_path)
    return rebuild_from_csv(spark, str(tmp_path / "internal.csv"),
                            str(tmp_path / "competitor.csv"), paths, str(tmp_path / "star"))


def test_rebuild_from_csv(spark, tmp_path):
    built = _rebuilt(spark, tmp_path)
    star = built["star"]
    # the rows without a SKU or a readable date are dropped; 4 * 0.125 is imputed
    assert star["fact_internal_sales"].count() == 4
    assert M.total_revenue(star, year=2024, brand="Lanterna").collect()[0][0] == 25.5
    assert {r.brand for r in star["dim_product"].collect()} == {"Lanterna", "Croaker", "Unknown"}
    assert {r.retailer for r in star["dim_retailer"].collect()} == {"CornerShop", "HarborHall"}
    s = M.market_share(star, year=2024, category="Lighting").collect()[0]
    assert s.internal_sales == 25.5 and s.competitor_sales == 1000.0
    q = {(r.check, r.table_name): r.value for r in
         quality_counts(star, built["internal"], built["competitor"]).collect()}
    assert q["unparseable_date", "fact_internal_sales"] == 1
    assert q["dropped_date", "fact_internal_sales"] == 1
    assert q["dropped_product", "fact_internal_sales"] == 1
    assert q["null_competitor_volume", "fact_competitor_market"] == 1


def test_a_rebuild_never_answers_from_the_former_star(spark, tmp_path):
    star = _rebuilt(spark, tmp_path)["star"]
    assert M.total_revenue(star, year=2024).first()[0] == 25.5
    tables = {k: v for k, v in star.items() if k != "fact_weekly_summary"}
    fact = stage(tables["fact_internal_sales"].withColumn("total_sales", F.lit(999.0)), "fact")
    tables = {k: stage(v, k) for k, v in tables.items()} | {"fact_internal_sales": fact}
    write_star(tables, str(tmp_path / "star"))
    again = read_star(spark, str(tmp_path / "star"))
    assert M.total_revenue(again).first()[0] == 999.0 * 4
    assert len([x for x in (tmp_path / "star").iterdir() if x.name.startswith("build-")]) == 1
    write_star(star, str(tmp_path / "star"), mode="ignore")      # kept
    assert M.total_revenue(read_star(spark, str(tmp_path / "star"))).first()[0] == 999.0 * 4


def test_a_failed_rebuild_leaves_the_former_star(spark, tmp_path):
    star = _rebuilt(spark, tmp_path)["star"]
    broken = dict(star, fact_competitor_market=star["fact_competitor_market"].withColumn(
        "competitor_sales", F.raise_error(F.lit("stop")).cast("double")))
    with pytest.raises(Exception, match="stop"):
        write_star(broken, str(tmp_path / "star"))
    assert M.total_revenue(read_star(spark, str(tmp_path / "star")), year=2024).first()[0] == 25.5


def test_streaming_ingest(spark, tmp_path):
    paths = write_inputs(tmp_path)
    aliases = {k: read_alias_csv(spark, p) for k, p in paths.items()}
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "week1.csv").write_text(INTERNAL)
    q = ingest(spark, "internal", str(drop), str(tmp_path / "landed"), str(tmp_path / "ck"), aliases)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "landed"))
    assert out.count() == 6
    assert {r.brand for r in out.collect()} == {"Lanterna", "Croaker", "Unknown"}
    # a second run with a new file only processes the new file
    (drop / "week2.csv").write_text(INTERNAL)
    q = ingest(spark, "internal", str(drop), str(tmp_path / "landed"), str(tmp_path / "ck"), aliases)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "landed"))
    assert out.count() == 12 and out.select("batch_id").distinct().count() == 2


def test_a_drop_in_another_column_order_stops_the_stream(spark, tmp_path):
    paths = write_inputs(tmp_path)
    aliases = {k: read_alias_csv(spark, p) for k, p in paths.items()}
    drop = tmp_path / "drop_o"
    drop.mkdir()
    lines = [x.split(",")[::-1] for x in COMPETITOR.strip().split("\n")]
    (drop / "w.csv").write_text("\n".join(",".join(x) for x in lines))
    q = ingest(spark, "competitor", str(drop), str(tmp_path / "l"), str(tmp_path / "c"), aliases)
    with pytest.raises(Exception, match="(?i)header"):
        q.awaitTermination(120)
    q = ingest(spark, "competitor", str(drop), str(tmp_path / "l2"), str(tmp_path / "c2"), aliases,
               columns=COMPETITOR.split("\n")[0].split(",")[::-1])
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "l2")).count() == 2


def test_clean_export_and_text_audit(spark, tmp_path):
    paths = write_inputs(tmp_path)
    aliases = {k: read_alias_csv(spark, p) for k, p in paths.items()}
    ci, cc = clean_feeds(read_internal_csv(spark, str(tmp_path / "internal.csv")),
                         read_competitor_csv(spark, str(tmp_path / "competitor.csv")), aliases)
    write_clean(ci, str(tmp_path / "out_internal"), fmt="csv")
    write_clean(cc, str(tmp_path / "out_competitor"))
    back = spark.read.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "enforceSchema"}).csv(
        str(tmp_path / "out_internal"))
    assert back.count() == 6 and "LANTERNA " in {r.Reported_Brand for r in back.collect()}
    assert spark.read.parquet(str(tmp_path / "out_competitor")).count() == 2
    a = {r.year: r for r in sales_text_audit(ci).collect()}
    # 2024: "25.0", and three read as missing
    assert (a[2024].rows, a[2024].missing_reported, a[2024].imputed_rows, a[2024].null_sales) == \
        (4, 3, 2, 1)
    assert (a[None].unparseable_reported, a[None].imputed_rows) == (1, 1)    # 100D is no number


def test_streaming_ingest_competitor(spark, tmp_path):
    paths = write_inputs(tmp_path)
    aliases = {k: read_alias_csv(spark, p) for k, p in paths.items()}
    drop = tmp_path / "drop_c"
    drop.mkdir()
    (drop / "week1.csv").write_text(COMPETITOR)
    q = ingest(spark, "competitor", str(drop), str(tmp_path / "landed_c"), str(tmp_path / "ck_c"),
               aliases)
    q.awaitTermination(120)
    out = {(r.category, r.retailer): r for r in spark.read.parquet(str(tmp_path / "landed_c")).collect()}
    assert set(out) == {("Lighting", "CornerShop"), ("Lighting", "HarborHall")}
    assert out[("Lighting", "CornerShop")].competitor_volume == 100
    assert out[("Lighting", "HarborHall")].competitor_sales is None

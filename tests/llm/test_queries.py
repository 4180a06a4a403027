import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shelfwise.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert "pipeline" in names and set(Q.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_its_sql(spark, con, name):
    got = Q.queries()[name](spark, SF)
    cur = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    assert (sorted((tuple(plain(v) for v in r) for r in got.select(*cols).collect()), key=repr)
            == sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(step(spark, last, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "language_id":
            assert out.count() == docs.where("text rlike '\\\\p{L}'").count()
        if name in ("exact_dedup", "ngram_join"):
            assert 0 < out.count() < last.count()
            assert out.count() == out.select("doc_id").distinct().count()
        if name == "mix_sources":
            most = out.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
            assert most <= 3
        last = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, last, SF).toPandas()
    full = pieces.groupby("sequence_id").length.sum().sort_index()
    assert (full.iloc[:-1] == 2048).all()
    assert set(pieces.doc_id) == {r.doc_id for r in last.select("doc_id").collect()}


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    from helpers import documents

    rows = [(i, "the and of " * 30 + f"w{i}", "en", "a") for i in range(30)]
    rows += [(50, None), (51, ""), (52, "123"), (None, "the and of it"), (1, rows[1][1], "en", "a")]
    documents(spark, rows, tmp_path / "documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    documents(spark, [], tmp_path / "none" / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

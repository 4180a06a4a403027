import random

import numpy as np
import pytest

from helpers import documents
from shelfwise.llm import byte_cnn as B
from shelfwise.llm import toxicity as T
from shelfwise.llm.queries import queries

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_the_held_out_fold(spark):
    got = queries()["op10_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "and", "of"]) for _ in range(40)), "en")
            for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(["der", "und", "ß"]) for _ in range(40)), "de")
             for i in range(60)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!! 456", "en"), (203, "der", None),
             (204, "the and of " * 20_000, None), (None, "und der ß und der", None),
             (205, "the and", None), (205, "the and", None)]
    got = {r.doc_id: r for r in B.identify(documents(spark, rows, tmp_path / "d")).collect()}
    assert got[204].lang_pred == "en" and got[None].lang_pred == "de"
    for i in (200, 201, 202):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert B.identify(documents(spark, rows, tmp_path / "e")).count() == len(rows)
    kept = B.keep_known(documents(spark, rows, tmp_path / "f"))
    assert {r.doc_id for r in kept.collect()} == {d for d, t, _ in rows if d not in (200, 201, 202)}


def test_language_without_labels_or_rows(spark, tmp_path):
    got = B.identify(documents(spark, [(1, "abc", None)], tmp_path / "d")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert B.identify(documents(spark, [], tmp_path / "e")).count() == 0


def test_windows_cover_every_byte_once():
    from shelfwise.llm.textbytes import text_buffer
    import pyarrow as pa

    texts = ["", "a" * 255, "b" * 256, "c" * 257, None, "é" * 700]
    x, used, doc = B.cut_windows(*text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert used[doc == i].sum() == len((t or "").encode())
    assert ((x == B.PAD).sum(axis=1) == B.WINDOW - used).all()


def _toxic_rows(n, rng):
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}"
             for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilezork", "grumjax", "PLOTHEX"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_edges(spark, tmp_path):
    rows, labels = _toxic_rows(600, random.Random(3))
    rows += [(900, None), (901, ""), (None, "grumjax bal"), (902, "bal " * 40_000), (0, rows[0][1])]
    labels += [(900, None), (None, 1), (901, None), (4, 1), (4, None), (777_777, 1)]
    docs = documents(spark, rows, tmp_path / "d")
    lab = spark.createDataFrame([(d, 1, t, "x") for d, t in labels],
                                "doc_id long, quality int, toxic int, text string")
    got = T.score_documents(docs, lab).collect()
    assert len(got) == len(rows)
    truth = dict(labels[:600])
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score < 0.5 and by_id[902].predicted == 0
    assert by_id[None].predicted == 1


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_toxicity_without_both_labels(spark, tmp_path, labels, score):
    docs = documents(spark, [(i, "some words") for i in range(1, 6)], tmp_path / "d")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.score_documents(docs, lab).collect()
    assert len(got) == 5 and all(abs(r.score - score) < 1e-3 for r in got)


def test_presence_counts_once_and_stays_in_its_text():
    import pyarrow as pa
    from shelfwise.llm.textbytes import text_buffer

    texts = ["abcabc", "ABC", "ab", None, "", "cab"]
    doc, gram = T.found(*text_buffer(pa.array(texts)))
    n = [len({t.lower()[i:i + k] for k in T.ORDERS for i in range(len(t) - k + 1)})
         for t in (x or "" for x in texts)]
    assert np.bincount(doc, minlength=len(texts)).tolist() == n
    assert len(gram) == sum(n)

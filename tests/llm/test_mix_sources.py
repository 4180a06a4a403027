import hashlib
from collections import defaultdict

import pytest

from helpers import documents, split_words
from shelfwise.llm import mix_sources as M

ROWS = ([(i, "w " * (i % 7 + 1), None, "big") for i in range(300)]
        + [(1000 + i, "w " * (i % 5), None, "aa") for i in range(40)]
        + [(2000 + i, "x y z", None, "zz") for i in range(20)]
        + [(3000 + i, "q", None, None) for i in range(10)]
        + [(4000, None, None, "empty"), (4001, "", None, "empty")]
        + [(5000, "v " * 5000, None, "long"), (5000, "v " * 5000, None, "long"),
           (None, "n n n", None, "aa")])


def water_fill(sizes, weights):
    """Share by weight; what is above three times a source's size is reshared
    until none is above."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > 3 * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: 3 * sizes[s] for s in full}
        open_ -= full


def test_targets_and_taken_words(spark, tmp_path):
    got = M.mix(documents(spark, ROWS, tmp_path / "d")).collect()
    assert len(got) == len(ROWS)
    size, source_of = defaultdict(int), {}
    for d, t, _, s in ROWS:
        size[s] += len(split_words(t))
        source_of[d] = s
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = water_fill(size, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.taken in [r.size * k for k in range(4)]
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in size:   # at most half a document (the repeated long one: two rows) beside it
        slack = longest[s] / 2 * (2 if s == "long" else 1)
        assert abs(taken[s] - want[s]) <= slack + 1e-6


def test_reruns_agree_and_rows_repeat_as_often_as_taken(spark, tmp_path):
    docs = documents(spark, ROWS, tmp_path / "d")
    a = sorted(map(tuple, M.mix(docs).collect()), key=repr)
    b = sorted(map(tuple, M.mix(docs.repartition(7)).collect()), key=repr)
    assert a == b
    out = M.apply_mix(docs)
    assert out.columns == docs.columns
    mixed = out.selectExpr("sum(size(split(trim(text), ' +'))) FILTER (WHERE trim(text) <> '')")
    assert mixed.first()[0] == sum(r[4] for r in a)


def test_hash_and_word_count(spark):
    df = spark.createDataFrame([(12, " a\tb\x0bc  d\u00a0e \r\n"), (None, None)],
                               "doc_id long, text string")
    rows = M.sized(df.selectExpr("*", "'s' AS source")).collect()
    h = int(hashlib.md5(b"12").hexdigest()[:12], 16)
    assert (rows[0].size, rows[0].h, rows[1].size) == (4, h, 0)


def test_empty_table(spark, tmp_path):
    docs = documents(spark, [], tmp_path / "d")
    assert M.mix(docs).count() == 0 and M.apply_mix(docs).count() == 0

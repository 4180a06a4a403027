import hashlib
import re
from collections import defaultdict

from helpers import documents
from shelfwise.llm import exact_dedup as E

ROWS = [(5, "a b  c"), (2, "abc"), (9, "a\tb\nc "), (3, "a b  c"), (3, "a b  c"), (7, None),
        (8, ""), (6, " \r\n"), (None, "zz"), (4, "z z"), (1, "é\u00a0x"), (10, "é\u00a0 x"),
        (11, "y" * 100_000), (12, "Abc")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_contract_against_brute_force(spark, tmp_path):
    got = E.exact_dedup(documents(spark, ROWS, tmp_path / "d")).collect()
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[norm(t)].append((-len(t or ""), d is None, d, t))
    assert len(got) == len(ROWS)
    for key, members in groups.items():
        sha = hashlib.sha256(key.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        assert len(mine) == len(members) == mine[0].group_size
        best = sorted(members, key=lambda m: (m[0], m[1], m[2] or 0))[0]
        assert {r.keep_id for r in mine} == {best[2]}
        assert [r.doc_id for r in mine if r.kept] == [best[2]]     # repeated rows leave one


def test_lasting_index_takes_new_batches_and_replays(spark, tmp_path):
    index = "file://" + str(tmp_path / "index")
    first = documents(spark, [(1, "a"), (2, "b")], tmp_path / "one")
    second = documents(spark, [(3, "a "), (4, "c"), (5, "c")], tmp_path / "two")
    run = lambda docs, batch: sorted((r.doc_id, r.keep_id, r.kept) for r in
                                     E.exact_dedup(docs, index, batch, buckets=4).collect())
    assert run(first, "one") == [(1, 1, True), (2, 2, True)]
    assert run(second, "two") == [(3, 1, False), (4, 4, True), (5, 4, False)]
    assert run(second, "two") == [(3, 1, False), (4, 4, True), (5, 4, False)]   # a replay
    name = E.open_index(spark, index, 4)
    assert spark.table(name).count() == 3


def test_index_side_of_the_anti_join_is_not_shuffled(spark, tmp_path):
    index = E.open_index(spark, "file://" + str(tmp_path / "index"), 4)
    new = (spark.range(100).selectExpr("unhex(sha2(string(id), 256)) AS digest")
           .repartition(4, "digest"))
    plan = new.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange") == 1


def test_dropping_keeps_columns(spark, tmp_path):
    docs = documents(spark, ROWS, tmp_path / "d")
    kept = E.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({norm(t) for _, t in ROWS})
    assert E.drop_exact_copies(documents(spark, [], tmp_path / "e")).count() == 0


def test_input_that_is_no_file_scan(spark):
    assert E.drop_exact_copies(documents(spark, [(1, "a"), (2, "a"), (3, "b")])).count() == 2

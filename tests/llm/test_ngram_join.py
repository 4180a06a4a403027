import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, split_words, words
from shelfwise.llm import ngram_join as N


def shingle_set(text, k):
    w = split_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                links.add((b, a))
                root[find(a)] = find(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            ids[r] = min(d, ids.get(r, d))
    return ([(d, len(s), ids.get(find(i)) if s else d)
             for i, ((d, _), s) in enumerate(zip(rows, sets))],
            {(min(rows[a][0], rows[b][0]), max(rows[a][0], rows[b][0]))
             for a, b in links if sets[a] != sets[b]})


def corpus(seed, size, n_words, edits):
    """Groups of near copies, some chains, with awkward rows around them."""
    rng, rows = random.Random(seed), []
    for g in range(size):
        base = words(rng, rng.randint(*n_words))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows.append(" ".join(w) if rng.random() < .7 else "\n".join(x.upper() for x in w))
            if rng.random() < .3:
                base = w
    rows += [None, "", " \t\n", "one", "One", "one two three", "one two three four",
             "Ünï cödé ẞ words Á b", "ünï cödé ẞ words Á b", "x" * 50_000]
    ids = list(range(1, len(rows) + 1))
    rng.shuffle(ids)
    rows = list(zip(ids, rows))
    return rows + rows[:3]


@pytest.mark.parametrize("k,percent,n_words,edits", [
    (4, 85, (5, 60), 2), (5, 80, (40, 300), 5), (2, 60, (3, 30), 4)])
def test_components_equal_brute_force(spark, tmp_path, k, percent, n_words, edits):
    rows = corpus(k, 40, n_words, edits)
    got = N.jaccard_components(documents(spark, rows, tmp_path / "d"), k, percent).collect()
    want, _ = brute(rows, k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)


def test_hot_group_of_near_copies_is_one_component(spark, tmp_path):
    rng = random.Random(5)
    base = words(rng, 120)
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(rng, 120))) for i in range(50)]
    got = {r.doc_id: r.component_id
           for r in N.jaccard_components(documents(spark, rows, tmp_path / "d"), 4, 85).collect()}
    want = {d: c for d, _, c in brute(rows, 4, 85)[0]}
    assert got == want


def test_all_links_equal_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t in corpus(9, 25, (6, 90), 3)]
    rows = list(dict(rows).items())                     # distinct ids
    seen, distinct = set(), []
    for d, t in sorted(rows):                           # one document of each set
        s = shingle_set(t, 4)
        if s not in seen:
            seen.add(s)
            distinct.append((d, t))
    got = N.all_links(documents(spark, distinct, tmp_path / "d"), 4, 85).collect()
    assert {(r.doc_a, r.doc_b) for r in got} == brute(distinct, 4, 85)[1]


def test_light_and_heavy_sets_find_the_same_links(spark, tmp_path, monkeypatch):
    rows = corpus(11, 25, (10, 60), 2)
    want = Counter(brute(rows, 4, 85)[0])
    docs = documents(spark, rows, tmp_path / "d")
    for edge in (0, 20, 4096):
        monkeypatch.setattr(N, "boundary", lambda *a, e=edge: e)
        got = N.jaccard_components(docs, 4, 85).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_boundary_prefers_subsets_for_small_sets_only():
    sizes = np.array([10, 1000])
    assert 10 <= N.boundary(sizes, np.array([100, 100]), 85) < 1000


def test_empty_table(spark, tmp_path):
    assert N.jaccard_components(documents(spark, [], tmp_path / "d"), 4, 85).count() == 0


def test_keep_one_keeps_columns_and_wordless_rows(spark, tmp_path):
    t = " ".join(words(random.Random(1), 50))
    docs = documents(spark, [(3, t), (1, t.upper()), (1, t), (None, t), (7, ""), (8, None),
                             (9, "other words here")], tmp_path / "d")
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8, 9]


def inputs_by_kind(spark, rows, path):
    """The same rows in memory, as a union and by explode over a scan, and the
    files of one folder named twice."""
    half = len(rows) // 2
    files = documents(spark, rows[:half], path / "half")
    pair = documents(spark, rows, path / "all")
    return {"memory": (documents(spark, rows), rows),
            "union": (files.unionByName(documents(spark, rows[half:])), rows),
            "explode": (pair.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))), rows * 2),
            "twice": (spark.read.parquet(str(path / "all"), str(path / "all")), rows * 2)}


def test_every_kind_of_input_is_joined_whole(spark, tmp_path):
    rows = corpus(21, 8, (60, 120), 2)
    for kind, (docs, plain) in inputs_by_kind(spark, rows, tmp_path).items():
        got = N.jaccard_components(docs, 4, 85).collect()
        want, links = brute(plain, 4, 85)
        assert links
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want), kind


def test_one_of_each_stays_for_every_kind_of_input(spark, tmp_path):
    rows = corpus(22, 8, (60, 120), 2)
    for kind, (docs, plain) in inputs_by_kind(spark, rows, tmp_path).items():
        kept = N.keep_one_of_each(docs, 4, 85)
        want, _ = brute(plain, 4, 85)
        ids = Counter(c for _, n, c in set(want) if n) & Counter({c: 1 for _, _, c in want})
        ids += Counter(d for d, n, _ in want if not n)
        assert kept.columns == docs.columns, kind
        assert Counter(r.doc_id for r in kept.collect()) == ids, kind

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import documents, words
from shelfwise.llm import lexical as L

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut(text):
    return [t.lower() if t.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in t)
            for t in TERM.findall((text or "").encode())]


def brute(docs, items, k=50):
    """Every document against every item, straight from the definition."""
    counts = [(d, Counter(cut(t))) for d, t in docs]
    holding = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            score = 0
            for t in set(cut(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * holding + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + (50 * sum(c.values()) * holding) // total
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, rank string")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed):
    # small slices, windows and pieces, so that every one of them ends somewhere
    for name, value in (("SLICE_BYTES", 6000), ("WINDOW", 8), ("SHORT_SHARE", 6)):
        monkeypatch.setattr(L, name, value)
    monkeypatch.setattr(L.pieces, "__defaults__", (700,))
    rng = random.Random(seed)
    docs = [(i, " ".join(words(rng, rng.randint(1, 120), rng.choice([8, 60, 900])))) for i in range(400)]
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""),
             (902, "-- ... \n"), (903, "É É w1 W1;w1_w1 \x00w2"), (904, "w3 " * 3000)]
    asked = [(i, " ".join(words(rng, 25, rng.choice([8, 60, 900])))) for i in range(30)]
    asked += [(3, asked[3][1]), (None, "w1 w2"), (40, None), (41, ""), (42, "nowhere"), (43, "É w3")]
    got = rows(L.rank(documents(spark, docs, tmp_path / "d"),
                      items(spark, [(*x, "x") for x in asked]), block_terms=300))
    assert got == brute(docs, asked)


def test_windows_are_skipped_and_lists_left_unread():
    rng = np.random.default_rng(4)
    texts = [" ".join(["common"] * int(rng.integers(1, 4)) + ["other"] * int(rng.integers(1, 30)))
             for _ in range(5000)]
    texts[10] = "common rare"
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    vocabulary = [b"common", b"rare"]
    import pyarrow as pa

    n, key, tf = L.invert(data, offsets, pa.array(vocabulary, pa.binary()))
    term, doc = key // 5000, key % 5000
    part = L.Slice({"n": n.tobytes(), "docs": doc.astype("<i4").tobytes(),
                    "tfs": tf.astype("<i4").tobytes(), "terms": np.arange(2, dtype="<i4").tobytes(),
                    "sizes": np.bincount(term).astype("<i4").tobytes(),
                    "doc_ids": list(range(5000))}, 5000, int(n.sum()))
    best = L.Best(1)
    seen = []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                seen.append(at)
            return super().__getitem__(at)

    part.docs = part.docs.view(Spy)
    L.search(part, np.arange(2), L.term_weights(5000, np.array([5000, 1])), best)
    assert best.doc == [10]
    assert len(seen) <= 2       # of the long list one window at most; the rest is skipped


def test_very_long_text_and_a_single_endless_term(spark):
    text = "alpha beta " * 400_000          # several pieces
    docs = [(1, text), (2, "x" * 5_000_000), (3, "alpha")]
    asked = [(1, "alpha"), (2, "x" * 5_000_000)]
    got = rows(L.rank(documents(spark, docs), items(spark, [(*x, "") for x in asked])))
    assert got == brute(docs, asked)


def test_large_counts_stay_whole_numbers():
    row = {"n": np.array([10 ** 9]).tobytes(), "docs": np.zeros(1, "<i4").tobytes(),
           "tfs": np.array([7], "<i4").tobytes(), "terms": np.zeros(1, "<i4").tobytes(),
           "sizes": np.ones(1, "<i4").tobytes(), "doc_ids": [1]}
    n_docs, total = 10 ** 12, 10 ** 14
    m = 50 + 50 * 10 ** 9 * n_docs // total
    assert L.Slice(row, n_docs, total).value.tolist() == [7 * 10 ** 9 // (7000 + 20 * m)]


def test_empty_tables(spark, tmp_path):
    some = documents(spark, [(1, "a b")])
    none = documents(spark, [], tmp_path / "n")
    asked = items(spark, [(1, "a", "")])
    assert L.rank(none, asked).count() == 0
    assert L.rank(some, asked.limit(0)).count() == 0
    assert L.rank(some, asked).columns == ["item_id", "rank", "doc_id", "score"]

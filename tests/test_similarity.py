import random
from difflib import SequenceMatcher, get_close_matches

import pytest

from shelfwise.functions import similarity as S
from shelfwise.operators import resolve as R

SYLLABLES = "lan ter na crok or sil mor vex ban dur pol ket fin gra wod hul zim eth qua brin tol mar".split()


def name(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5)))


def typo(rng, s):
    out = list(s)
    for _ in range(rng.randint(1, 2)):
        at = rng.randrange(len(out))
        out[at] = rng.choice(["", rng.choice("aesxz"), out[at] * 2])
    return "".join(out)


def frames(spark, words, texts):
    values = spark.createDataFrame([(0, w) for w in words], "e int, raw string")
    pool = spark.createDataFrame([(0, t, t) for t in texts], "e int, text string, canonical string")
    return values, pool


@pytest.mark.parametrize("cutoff", [0.0, 0.3, 0.5, 0.75, 0.9, 1.0])
def test_best_match_equals_get_close_matches(spark, monkeypatch, cutoff):
    monkeypatch.setattr(R, "ROUNDS_FROM_BUCKETS", 0)        # in rounds, as for many values
    rng = random.Random(4)
    texts = sorted({name(rng) for _ in range(150)} | {"", "a", "aa", "Ümlaut", "日本", "🙂 x"})
    words = sorted({typo(rng, rng.choice(texts[5:])) for _ in range(80)}
                   | {"", "a", "qqqq", "UPPER", "🙂", "aab", texts[9]})
    values, pool = frames(spark, words, texts)
    got = {r.raw: r.canonical for r in R._fuzzy_pass(values, pool, {0: cutoff}, "canonical").collect()}
    want = {w: get_close_matches(w, texts, 1, cutoff) for w in words}
    assert got == {w: m[0] for w, m in want.items() if m}


def test_upper_bounds_are_those_of_difflib():
    rng = random.Random(5)
    texts = [name(rng) for _ in range(60)] + ["", "aab", "日本日", "🙂"]
    words = [typo(rng, rng.choice(texts[:60])) for _ in range(40)] + ["", "aaab", "日日", "q"]
    got = S.upper_bounds(words, texts)
    for i, w in enumerate(words):
        for j, t in enumerate(texts):
            assert got[i, j] == SequenceMatcher(None, t, w).quick_ratio()


def test_few_pairs_are_compared_in_full(monkeypatch):
    rng = random.Random(6)
    texts = sorted({name(rng) + name(rng) for _ in range(1000)})
    words = sorted({typo(rng, rng.choice(texts)) for _ in range(200)})
    calls = []

    class Counting(SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(S, "SequenceMatcher", Counting)
    bounds = S.upper_bounds(words, texts)
    got = {w: S.best_match(w, texts, R.FUZZY_STEPS[0], b) for w, b in zip(words, bounds)}
    assert len(calls) < 0.01 * len(words) * len(texts)
    for w, m in got.items():
        want = get_close_matches(w, texts, 1, R.FUZZY_STEPS[0])
        assert (m[1:] if m else ()) == tuple(want)

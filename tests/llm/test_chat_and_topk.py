import random
from collections import defaultdict

import pytest

from shelfwise.llm import binary_topk as K
from shelfwise.llm import chat_views as C

TURNS = [(1, 0, "ann", "hello"), (1, 1, "bob", "hi <|end|>"), (1, 2, "system", "be kind"),
         (1, 3, "ann", None), (1, 3, "ann", "é\nx"), (1, None, "cy", ""), (1, 300, "bob", "late"),
         (2, 0, "system", "alone"), (None, 1, None, "who"), (None, 0, "", "am i"),
         (3, 0, "ann", "same"), (3, 0, "ann", "same"), (4, 5, "dee", "z" * 60_000)]


def brute(turns):
    plain = lambda s: (s or "").replace("<|", "< |")
    convs = defaultdict(list)
    for c, t, r, x in turns:
        convs[c].append((t is not None, t or 0, plain(r) or "unknown", plain(x)))
    out = {}
    for c, rows in convs.items():
        for who in {r[2] for r in rows} - {"system"}:
            parts = defaultdict(list)
            for r in sorted(rows):
                parts[r[1] // 256].append(r)
            at = 0
            for p in sorted(parts):
                text, mask = "", []
                for _, _, role, x in parts[p]:
                    kind = ("assistant" if role == who else "system" if role == "system"
                            else f"user {role}")
                    text += f"<|{kind}|>\n"
                    if role == who:
                        mask.append((len(text), len(text) + len(x) + 7))
                    text += x + "<|end|>\n"
                out[c, who, p] = (at, len(parts[p]), text, mask)
                at += len(text)
    return out


def test_views_equal_brute_force(spark):
    turns = spark.createDataFrame([(*t, "c", 1) for t in TURNS],
                                  "conv_id long, turn long, role string, text string, "
                                  "speaker string, part int")
    got = {(r.conv_id, r.speaker, r.part):
           (r.char_start, r.n_turns, r.text, [(m.start, m.end) for m in r["mask"]])
           for r in C.rotate(turns).collect()}
    assert got == brute(TURNS)
    for _, _, text, mask in got.values():
        assert all(text[a:b].endswith("<|end|>") for a, b in mask)
    assert C.rotate(turns.limit(0)).count() == 0


def code(v):
    return tuple(x is not None and x > 0 for x in v)


def brute_topk(rows, queries, k, dims):
    out = set()
    ids = {i: code(list(v) + [0] * (dims - len(v))) for i, v in rows if v is not None}
    for q, v in queries:
        if v is None:
            continue
        c = code(list(v) + [0] * (dims - len(v)))
        near = sorted((sum(a != b for a, b in zip(c, d)), i) for i, d in ids.items() if i != q)
        out |= {(q, n + 1, i, dist) for n, (dist, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("dims,n,k", [(64, 400, 5), (20, 300, 7), (100, 200, 4), (8, 6, 10)])
def test_topk_equals_brute_force(spark, dims, n, k):
    rng = random.Random(dims)
    centre = [rng.uniform(-1, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        if i % 3 == 0:                      # a third of the rows share a code
            rows.append((i, centre))
        elif i % 3 == 1:
            rows.append((i, [x if rng.random() < .9 else -x for x in centre]))
        else:
            rows.append((i, [rng.uniform(-1, 1) for _ in range(dims)]))
    rows += [(n, None), (n + 1, centre[:dims // 2]), (n + 2, [0.0] * dims)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + rows[:2]],
                               "vec_id long, embedding array<float>, distance int")
    queries = [r for r in rows if r[0] % 10 == 0]
    got = K.top_k(df, df.where("vec_id % 10 = 0"), k).collect()
    assert {tuple(r) for r in got} == brute_topk(rows, queries, k, dims)
    assert len(got) == len({tuple(r) for r in got})


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.top_k(df, df, 3).count() == 0


def test_topk_broadcasts_no_values_looked_up(spark, monkeypatch):
    """Long segments, and buckets of several cells: the values within the radii
    are thousands a query and must not pass through the driver."""
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(4)]
    rows = [(i, [x if rng.random() < .93 else -x for x in centres[i % 4]]) for i in range(240)]
    monkeypatch.setattr(K, "segment_bits", lambda codes, bits: 16)
    monkeypatch.setattr(K, "BUCKET_ENTRIES", 3, raising=False)
    plans, stage = [], K.stage

    def seen(df, name, codec=None):
        if name == "near-codes":
            plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return stage(df, name, codec)

    monkeypatch.setattr(K, "stage", seen)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = K.top_k(df, df.where("vec_id % 20 = 0"), 6).collect()
    queries = [r for r in rows if r[0] % 20 == 0]
    assert {tuple(r) for r in got} == brute_topk(rows, queries, 6, 64)
    assert len(got) == 6 * len(queries)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    assert plans
    for lines in plans:
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = []
                for x in lines[i + 1:]:
                    if depth(x) <= depth(line):
                        break
                    below.append(x)
                assert not any("Generate" in x for x in below)

import hashlib
import math
import random
import re
import string

from helpers import documents, words
from shelfwise.llm import secrets as S

NAMES = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
PLAIN = [(ASSIGN, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
         (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base(text):
    spans = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN)
             for m in p.finditer(text or "") if ok(m)]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def random_token(rng, n=32):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def hex_token(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


SYLLABLES = ("con fig re quest han dler inter na tion al cus tom er ac count num ber iden ti fi "
             "respon si bi li ties sen tence order ing part ment hour work ble").split()


def identifier(rng):
    parts = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))
             for _ in range(rng.randint(1, 2))]
    return rng.choice(["_".join, lambda p: p[0] + "".join(x.title() for x in p[1:])])(parts)


def corpus(rng):
    vocabulary = [identifier(rng) for _ in range(1500)]
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(40)]
        w[rng.randrange(40)] = f"password={random_token(rng, 24)}"
        w[rng.randrange(40)] = hex_token(rng, 40)
        yield i, " ".join(w)


CASES = ["", None, "no secret here", "password=abc", "PASSWORD = 'abcdef'", "api_key: x1y2z3.=-/",
         "password=token:abcdefgh", "apikey==abcdef secret:\"abcdefg\"", "paſsword=abcdefg",
         "KEY apiKey=abcdefg", "AKIAAKIA" + "B" * 16, "xAKIA" + "9" * 15 + " AKIA" + "9" * 16,
         "a" * 23 + "g" + "a" * 24, "🙂é token=" + "f" * 30 + " 🙂 AKIA" + "Z" * 20,
         "secret=1\nsecret=123456", "passwd:\x20\x20\"" + "a" * 40]


def test_base_spans_equal_plain_regular_expressions(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(CASES)]
    rows += [(100 + i, "".join(rng.choice(["password", "token=", ":", " ", "a1b2c3", "AKIA", "Q9" * 5,
                                           "0f" * 6, "é", "🙂", "'", "="]) for _ in range(60)))
             for i in range(200)]
    rows += [(1000, " ".join(["token=" + "a1" * 4, "b" * 30] * 5000)), (1000, None), (None, "api-key")]
    got = S.report(S.scan(documents(spark, rows, tmp_path / "d"))).collect()
    want = sorted((str(i), joined(base(t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.spans) for r in got) == want
    plain = {(str(i), joined(base(t))): base(t) for i, t in rows}
    for r in got:
        spans = plain[(str(r.doc_id), r.spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(k == n for _, k, _ in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def plain_model(samples):
    """The two models once more, pair by pair in Python."""
    k, out = len(S.ALPHABET), {}
    for kind in (True, False):
        count = {}
        for token, is_random in samples:
            if is_random == kind and len(token) > 1:
                for a, b in zip([None, *token], token):
                    count[a, b] = count.get((a, b), 0) + 1
        for a in [None, *S.ALPHABET]:
            total = sum(count.get((a, b), 0) + S.SMOOTHING for b in S.ALPHABET)
            for b in S.ALPHABET:
                out[kind, a, b] = math.log((count.get((a, b), 0) + S.SMOOTHING) / total)
    assert len(out) == 2 * k * (k + 1)
    return lambda t: sum(out[True, a, b] - out[False, a, b] for a, b in zip([None, *t], t))


def test_models_equal_a_plain_computation_and_tell_tokens_apart(spark, tmp_path):
    rng = random.Random(5)
    docs = documents(spark, list(corpus(rng)), tmp_path / "d")
    samples = S.rule_samples(docs)
    ratio = plain_model([tuple(r) for r in samples.collect()])
    model = S.fit(samples)
    secrets = [random_token(rng) for _ in range(200)]
    ordinary = ["internationalConfiguration", "request_handler_identifier", "responsibility" * 2,
                "CUSTOMER_REQUEST_NUMBER", "1234567890123456", *(identifier(rng) for _ in range(50))]
    rows = [(i, f"see {t} there") for i, t in enumerate(secrets + ordinary)]
    got = {r.doc_id: r.spans for r in S.report(S.scan(documents(spark, rows), model)).collect()}
    for i, t in enumerate(secrets + ordinary):
        found = not t.isdigit() and ratio(t) >= S.MIN_RATIO
        assert got[i] == (f"markov:4:{4 + len(t)}" if found else ""), t
    assert sum(bool(got[i]) for i in range(200)) >= 198      # random strings the models never saw
    assert not any(got[i] for i in range(200, 200 + len(ordinary)))


def test_a_base_span_is_not_reported_twice(spark):
    rng = random.Random(6)
    docs = documents(spark, list(corpus(rng)))
    out = S.find_secrets(docs).collect()
    assert len(out) == 60
    for r in out:
        kinds = [s.split(":", 1) for s in r.spans.split(",")]
        hexes = {at for k, at in kinds if k == "hex"}
        assert len(hexes) == 1 and not hexes & {at for k, at in kinds if k == "markov"}


def test_without_samples_the_base_stays(spark, tmp_path):
    rng = random.Random(7)
    rows = [(1, " ".join(words(rng, 50))), (2, None)]
    assert [r.spans for r in S.find_secrets(documents(spark, rows)).collect()] == ["", ""]
    assert S.find_secrets(documents(spark, [], tmp_path / "e")).count() == 0


def test_sample_bound_holds_for_repeated_rows(spark):
    rng = random.Random(8)
    text = " ".join(words(rng, 300, 100_000)) + " token=" + random_token(rng)
    docs = documents(spark, [(1, text)] * 500 + list(corpus(rng)))
    got = S.rule_samples(docs, per_class=20, texts=3).groupBy("is_random").count().collect()
    assert all(r["count"] <= 20 for r in got) and len(got) == 2

"""Secret scans: fixed patterns, and character Markov models for the rest.

Three patterns give the base spans of a text.  Every other long run of token
characters is judged by two first-order Markov models over its characters: one
learnt from random strings, one from ordinary identifiers, both from labelled
samples.  The log-likelihood ratio of the two is the sum of one weight for each
pair of neighbouring characters; a run whose ratio reaches ``MIN_RATIO`` is a
span of kind ``markov``.

Only DataFrame functions are used.  The matches of a text and the pieces
between them (``regexp_extract_all``, ``split``) give its positions in code
points, so a text is judged where it lies: no row moves, and only the letter
counts of the samples are shuffled.

Defined results: a null text is an empty one and has no spans, so its base hash
is that of the empty string; equal texts have equal spans; a null or repeated
doc_id gives a row for each row; an empty table gives an empty result; extra
columns play no part, whatever their names.  Very long texts are scanned whole
in one row, with memory and (but for a square root of the number of matches in
one text) time in proportion to the text.  Without samples of both classes no
run is judged and the base spans remain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

# The patterns of the base kinds, in the order of the contract,
# the group whose length counts (0: the match) and its least length.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
BASE = (("assign", ASSIGN, 1, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
        ("hex", "[0-9a-f]{24,}", 0, 24))
MODEL_KIND = "markov"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
TOKEN = "[A-Za-z0-9+/_-]"
MIN_TOKEN = 16             # characters of a run that the models judge
MIN_WORD = 6               # characters of an ordinary identifier to learn from
MIN_RATIO = 10.0           # nats by which a random string must be the likelier one
SMOOTHING = 0.5
SAMPLE_TOKENS = 20_000     # bound of the labelled sample: distinct tokens of each class
SAMPLE_TEXTS = 2_000       # bound of the distinct texts that identifiers are taken from


@dataclass
class Model:
    """``weights[a * len(ALPHABET) + b]``: log of how much likelier ``b`` after
    ``a`` is in a random string; ``first[b]`` the same for a first character."""
    first: list[float]
    weights: list[float]


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, wherever ``f`` uses it: it
    becomes the element of a one-element array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def code(character: Column) -> Column:
    """Place of a character in ALPHABET, from 0; -1 for any other."""
    return F.instr(F.lit(ALPHABET), character) - 1


def running_sum(values: Column) -> Column:
    """Running totals of an array of integers, each including its own element.

    There is no running state in an array function, and a growing array is
    copied at each step; so totals of blocks of about sqrt(n) elements are made
    first, and each element adds the rest of its own block."""

    def total(a, start, length):      # start counts from 0
        return F.aggregate(F.slice(a, start + F.lit(1), length), F.lit(0).cast("long"),
                           lambda s, x: s + x)

    def by_blocks(v, b):
        count = F.floor((F.size(v) - 1) / b).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count), lambda k: total(v, k * b, b))
        return bind(sums, lambda s: bind(
            F.transform(s, lambda _, k: total(s, F.lit(0), k)),
            lambda before: F.transform(v, lambda _, i: F.get(before, F.floor(i / b).cast("int"))
                                       + total(v, i - F.pmod(i, b), F.pmod(i, b) + F.lit(1)))))

    def whole(v):
        return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(
            bind(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda b: by_blocks(v, b)))

    return bind(values, whole)


def matches(text: Column, pattern: str) -> Column:
    """All matches in order, leftmost first, none overlapping."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def starts(text: Column, pattern: str, found: Column) -> Column:
    """Code point at which each of the ``found`` matches begins: what lies
    between the matches, plus the matches before."""
    step = bind(F.split(text, pattern, -1), lambda between: F.transform(
        found, lambda _, i: F.length(F.get(between, i)).cast("long") + F.when(
            i == 0, F.lit(0)).otherwise(F.length(F.get(found, i - 1)))))
    return running_sum(step)


def _spans(kind_at: int, start: Column, found: Column, keep) -> Column:
    """(start, kind, end, value) of the matches that ``keep(match)`` holds for."""
    rows = bind(start, lambda s: F.transform(found, lambda m, i: F.struct(
        F.get(s, i).alias("start"), F.lit(kind_at).alias("kind"),
        (F.get(s, i) + F.length(m)).alias("end"), m.alias("value"))))
    return F.filter(rows, lambda r: keep(r["value"]))


def _long_enough(pattern: str, group: int, least: int):
    if group == 0:
        return lambda m: F.length(m) >= least
    return lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least


def log_ratio(token: Column, model: Model) -> Column:
    """Log-likelihood of ``token`` as a random string over that as an ordinary
    identifier.  ``token`` holds characters of ALPHABET alone."""
    k = len(ALPHABET)

    def table(values):      # one text literal, folded into one array
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")

    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: code(
        F.substring(token, i, F.lit(1))))
    pairs = bind(codes, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c) - 1), F.get(table(model.first), F.get(c, F.lit(0))),
        lambda s, i: s + F.get(table(model.weights), F.get(c, i - 1) * k + F.get(c, i))))
    return F.when(F.length(token) > 1, pairs)


def fit(samples: DataFrame) -> Model | None:
    """The two models from ``samples(token, is_random)``; None unless there
    are tokens of both classes.  Only the counts of character pairs reach the
    driver, one number for each class and pair of ALPHABET."""
    k = len(ALPHABET)

    at = F.explode(F.sequence(F.lit(1), F.length("token"))).alias("i")
    pairs = samples.where(F.length("token") > 1).select("is_random", "token", at).select(
        "is_random",
        F.when(F.col("i") > 1, code(F.substring("token", F.col("i") - 1, F.lit(1)))).alias("a"),
        code(F.substring("token", F.col("i"), F.lit(1))).alias("b"))
    counts = {(r["is_random"], r["a"], r["b"]): r["count"]
              for r in pairs.where("b >= 0 AND (a IS NULL OR a >= 0)")
              .groupBy("is_random", "a", "b").count().collect()}
    if {r for r, _, _ in counts} != {True, False}:
        return None

    def logs(is_random, a):
        row = [counts.get((is_random, a, b), 0) + SMOOTHING for b in range(k)]
        return [math.log(x / sum(row)) for x in row]

    def ratio(a):
        return [x - y for x, y in zip(logs(True, a), logs(False, a))]

    return Model(ratio(None), [x for a in range(k) for x in ratio(a)])


def rule_samples(docs: DataFrame, text_col: str = "text", per_class: int = SAMPLE_TOKENS,
                 texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(token, is_random), labelled by the base patterns: the values that they
    find anywhere are random strings; the other words of ``texts`` distinct
    texts, as they stand and in capitals, are ordinary identifiers.  Of each
    class the ``per_class`` tokens that come first by their hash."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    values = F.array_union(F.array_union(
        F.transform(F.filter(matches(F.col("text"), ASSIGN), _long_enough(ASSIGN, *BASE[0][2:])),
                    lambda m: F.regexp_extract(m, ASSIGN, 1)),
        matches(F.col("text"), BASE[1][1])), matches(F.col("text"), BASE[2][1]))
    # sentence marks and padding are no characters of the models
    random = stage(rows.select(values.alias("v")).where(F.size("v") > 0)
                   .select(F.explode("v").alias("v")).select(
                       F.regexp_replace("v", "[.=]", "").alias("token")).distinct(), "secret-values")
    hashed = rows.select(F.xxhash64("text").alias("h"), "text")
    # bounded: ``texts`` numbers
    few = hashed.select("h").distinct().orderBy("h").limit(texts)
    some = (hashed.join(F.broadcast(few), "h", "left_semi").groupBy("h")
            .agg(F.first("text").alias("text")))
    rest = F.col("text")
    for _, pattern, _, _ in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = (some.select(matches(rest, f"{TOKEN}{{{MIN_WORD},}}").alias("w"))
                .select(F.explode("w").alias("w")).where("w rlike '[A-Za-z]'").distinct()
                .join(random, F.col("w") == F.col("token"), "left_anti")
                .select(F.explode(F.array("w", F.upper("w"))).alias("token")))

    def first(df):      # in parallel but for the last merge of ``per_class`` rows a task
        return df.distinct().orderBy(F.xxhash64("token"), "token").limit(per_class)

    return stage(
        first(random.where(F.length("token") >= MIN_WORD)).withColumn("is_random", F.lit(True))
        .unionByName(first(ordinary).withColumn("is_random", F.lit(False))), "secret-samples")


def scan(docs: DataFrame, model: Model | None = None, text_col: str = "text",
         id_col: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row: ``spans`` is an array of (start, kind,
    end, value) in order of start, then kind; ``kind`` counts the base kinds
    from 0, then the models.  A run that is itself a base span is not judged."""
    kinds = [(p, _long_enough(p, g, n)) for _, p, g, n in BASE]
    if model is not None:
        # a run without a letter is a number
        kinds.append((f"{TOKEN}{{{MIN_TOKEN},}}",
                      lambda m: m.rlike("[A-Za-z]") & (log_ratio(m, model) >= MIN_RATIO)))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[matches(F.col("text"), p).alias(f"m{i}")
                                           for i, (p, _) in enumerate(kinds)])
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, value: string>>")
    rows = rows.select("doc_id", *[
        F.when(F.size(f"m{i}") == 0, none).otherwise(
            _spans(i, starts(F.col("text"), p, F.col(f"m{i}")), F.col(f"m{i}"), keep)).alias(f"s{i}")
        for i, (p, keep) in enumerate(kinds)])
    base = [f"s{i}" for i in range(len(BASE))]
    if model is None:
        return rows.select("doc_id", F.array_sort(F.concat(*base)).alias("spans"))
    def again(a, r, i):     # of equal start, the base kinds come first
        return F.exists(F.slice(a, F.greatest(i - len(BASE), F.lit(0)) + 1,
                                F.least(i, F.lit(len(BASE)))),
                        lambda x: (x["start"] == r["start"]) & (x["end"] == r["end"]))

    return rows.select("doc_id", bind(
        F.array_sort(F.concat(*base, f"s{len(BASE)}")),
        lambda a: F.filter(a, lambda r, i: (r["kind"] < len(BASE)) | ~again(a, r, i))).alias("spans"))


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the hash of the base
    spans and all spans as text."""
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(MODEL_KIND))

    def text(spans):
        return F.concat_ws(",", F.transform(spans, lambda r: F.concat_ws(
            ":", F.get(names, r["kind"]), r["start"], r["end"])))

    def count(i):
        return F.size(F.filter("spans", lambda r: r["kind"] == i)).cast("long")

    base = F.filter("spans", lambda r: r["kind"] < len(BASE))
    return scanned.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """The report of every document, with models learnt from what the base
    patterns label in the documents themselves."""
    return report(scan(docs, fit(rule_samples(docs))))

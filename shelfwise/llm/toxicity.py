"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios.

A text is the set of its byte n-grams (A-Z lower-cased), hashed.  From a
bounded sample of labelled rows Spark counts in how many toxic and other texts
each n-gram stands; r = log((p / |p|) / (q / |q|)) with add-one smoothing is
its ratio.  A logistic regression is trained on the presence of the strongest
n-grams, each scaled by its r, and the weight of an n-gram is its coefficient
times r.  Scoring looks every position of every whole text up in that table
and adds each distinct n-gram once.

Defined results: a null or empty text gets the classifier's base rate; a label
that is null is no label, of several labels for one doc_id the largest counts;
without labels of both kinds every score is the share of toxic labels (0
without any); repeated rows are all scored; an empty table gives an empty
result; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .textbytes import lower_ascii, text_buffer

ORDERS = (3, 4, 5, 6)        # bytes in an n-gram
BITS = 20                    # n-grams are hashed to 2**BITS features
SAMPLE_PER_CLASS = 3000      # bound of the training sample: rows of each label
FEATURES = 20_000            # n-grams the regression sees, the strongest ones
ROUNDS, RATE, L2 = 200, 0.05, 1e-4


@dataclass
class Model:
    features: np.ndarray     # hashed n-grams, sorted
    weights: np.ndarray      # coefficient x ratio
    bias: float


def ngram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-gram that starts at each byte; the last n - 1 are meaningless."""
    h = np.full(len(data), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h *= np.uint32(0x01000193)
        h[:len(data) - j] += data[j:].astype(np.uint32) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BITS)


def found(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None):
    """Distinct (document, n-gram) pairs of the texts as two arrays; with a
    table, only of n-grams whose entry is not zero."""
    data = lower_ascii(data)
    ends, keys = offsets[1:], []
    for n in ORDERS:
        if len(data) < n:
            continue
        h = ngram_hashes(data, n)
        at = np.arange(len(data)) if table is None else np.flatnonzero(table.take(h))
        doc = np.searchsorted(ends, at, side="right")
        whole = at + n <= ends[doc]
        keys.append((doc[whole].astype(np.int64) << BITS) | h[at[whole]])
    k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return k >> BITS, (k & ((1 << BITS) - 1)).astype(np.int64)


def _parts(batch: pa.RecordBatch, limit: int = 1 << 20):
    step = max(1, int(batch.num_rows * limit / max(1, batch.get_total_buffer_size())))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def sample(docs: DataFrame, labels: DataFrame, held_out, per_class: int) -> DataFrame:
    """(label, text) of the ``per_class`` labelled rows of each class that come
    first by the hash of their id, staged.  Their ids, at most twice that
    many, are broadcast, so the texts of all others never move."""
    given = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
             .where("label in (0, 1)"))
    by = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (given.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_class)
              .select("doc_id", "label"))
    return stage(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                 .join(F.broadcast(chosen), "doc_id").select("label", "text"), "toxic-sample")


def class_counts(labels: DataFrame, held_out) -> dict[int, int]:
    """Rows of each label among all that may be learnt from."""
    rows = (labels.where(F.col("toxic").isNotNull() & ~held_out).groupBy("toxic")
            .count().where("toxic in (0, 1)").collect())
    return {int(r["toxic"]): r["count"] for r in rows}


def log_count_ratios(rows: DataFrame, n_pos: int, n_neg: int, features: int):
    """(n-grams, ratios) of the ``features`` strongest n-grams of the sample,
    by ratio times the root of the texts they stand in."""

    def run(batches):
        size = 1 << BITS
        count = np.zeros(2 * size, np.int64)
        for b in batches:
            for s in _parts(b):
                label = s.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, gram = found(*text_buffer(s.column(1)))
                count += np.bincount(label[doc] * size + gram, minlength=2 * size)
        gram = np.flatnonzero(count[:size] + count[size:])
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram), pa.array(count[size:][gram]), pa.array(count[:size][gram])],
            ["gram", "pos", "neg"])

    sums = (rows.select("label", "text").mapInArrow(run, "gram long, pos long, neg long")
            .groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    ratio = F.log(((F.col("pos") + 1) / (n_pos + 2)) / ((F.col("neg") + 1) / (n_neg + 2)))
    best = (sums.select("gram", ratio.alias("r"),
                        (F.abs(ratio) * F.sqrt(F.col("pos") + F.col("neg"))).alias("s"))
            .orderBy(F.desc("s"), "gram").limit(features).select("gram", "r").toArrow())
    gram = best["gram"].to_numpy().astype(np.int64)
    order = np.argsort(gram)
    return gram[order], best["r"].to_numpy()[order]


def regress(x_row: np.ndarray, x_col: np.ndarray, y: np.ndarray, r: np.ndarray):
    """Coefficients and bias of a logistic regression on sparse rows whose
    entries are the ratios of the n-grams present (Adam, full batches)."""
    w, b, n = np.zeros(len(r)), 0.0, len(y)
    value = r[x_col]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(x_row, w[x_col] * value, n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw = np.bincount(x_col, g[x_row] * value, len(r)) + L2 * w
        gb = g.sum()
        m += 0.1 * (gw - m)
        v += 0.001 * (gw * gw - v)
        mb += 0.1 * (gb - mb)
        vb += 0.001 * (gb * gb - vb)
        a, c = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= RATE * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= RATE * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, held_out, per_class: int = SAMPLE_PER_CLASS,
        features: int = FEATURES) -> Model:
    """``held_out``: a condition on doc_id that holds for rows not to learn from."""
    counts = class_counts(labels, held_out)
    rows = sample(docs, labels, held_out, per_class)
    got = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    n_pos, n_neg = got.get(1, 0), got.get(0, 0)
    if not n_pos or not n_neg:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(odds))
    gram, r = log_count_ratios(rows, n_pos, n_neg, features)

    def present(batches):
        table = np.zeros(1 << BITS, bool)
        table[gram] = True
        for b in batches:
            for s in _parts(b):
                doc, g = found(*text_buffer(s.column(1)), table)
                col = np.searchsorted(gram, g).astype(np.int32)
                cut = np.searchsorted(doc, np.arange(s.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([col[a:z].tobytes() for a, z in zip(cut, cut[1:])],
                                           pa.binary())], ["label", "cols"])

    # bounded: 2 x per_class rows of at most ``features`` numbers
    xs = rows.select("label", "text").mapInArrow(present, "label int, cols binary").toArrow()
    pairs = sorted(zip(xs["label"].to_pylist(), xs["cols"].to_pylist()))
    y = np.array([p[0] for p in pairs], np.float64)
    cols = [np.frombuffer(p[1], np.int32) for p in pairs]
    w, bias = regress(np.repeat(np.arange(len(y)), [len(c) for c in cols]),
                      np.concatenate(cols), y, r)
    # the sample has its own share of toxic rows; move the base rate back
    prior = np.log(counts.get(1, 1) / counts.get(0, 1)) - np.log(n_pos / n_neg)
    return Model(gram, w * r, float(bias + prior))


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        table = np.zeros(1 << BITS, np.float32)
        table[model.features] = model.weights
        for b in batches:
            for s in _parts(b):
                doc, gram = found(*text_buffer(s.column(1)), table)
                z = np.bincount(doc, table[gram].astype(np.float64), s.num_rows) + model.bias
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                    ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def fold(column: str = "doc_id", parts: int = 5):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts == 0


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = with_score(docs, fit(docs, labels, fold()))
    return out.select("doc_id", fold().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))

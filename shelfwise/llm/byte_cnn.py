"""Language identification with a byte convolutional network.

The network looks at fixed windows of bytes: one filter bank per width over
one-hot bytes (a filter of width w is w rows of a 257 x filters table: 256
bytes and the padding), ReLU, max pooling over the window and a softmax layer.
It is trained in numpy on a bounded sample of labelled rows and applied to
every window of every text in Arrow batches; a text's score is the mean of its
windows' probabilities, weighted by their bytes.

Defined results: a null text, or one without a letter, is ``und`` with score
0; without any labelled row everything is ``und``; repeated rows are all
predicted; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import free_name
from .textbytes import text_buffer

WINDOW = 256               # bytes the network sees at once
WIDTHS = (2, 3, 4)
FILTERS = 12               # per width
PAD = 256
SAMPLE_PER_LANGUAGE = 400  # bound of the training sample, in rows of each language
WINDOWS_PER_ROW = 4        # evenly spaced training windows of a sampled row
EPOCHS, BATCH, RATE = 10, 64, 0.01
MIN_SCORE = 0.3            # a filter keeps what reaches it
CHUNK = 64                 # windows in one forward pass
SLICE_BYTES = 2 << 20      # texts cut into windows at a time


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]   # per width: [width, 257, filters]
    bias: np.ndarray           # [widths * filters]
    dense: np.ndarray          # [widths * filters, languages]
    out: np.ndarray            # [languages]


def convolve(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[windows, positions, filters] of one filter bank."""
    width = len(table)
    n = x.shape[1] - width + 1
    y = table[0].take(x[:, :n], axis=0, mode="clip")
    for j in range(1, width):
        y += table[j].take(x[:, j:j + n], axis=0, mode="clip")
    return y


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Softmax output for windows ``x`` [n, WINDOW] of byte values."""
    out = np.empty((len(x), len(model.langs)), np.float32)
    for a in range(0, len(x), CHUNK):
        w = x[a:a + CHUNK]
        pooled = np.concatenate([convolve(w, t).max(axis=1) for t in model.tables], axis=1)
        z = np.maximum(pooled + model.bias, 0) @ model.dense + model.out
        e = np.exp(z - z.max(axis=1, keepdims=True))
        out[a:a + CHUNK] = e / e.sum(axis=1, keepdims=True)
    return out


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Adam on the cross entropy.  Max pooling passes a filter's gradient to
    one position of each window, so the tables' gradients are sparse sums."""
    rng = np.random.default_rng(seed)
    k, c = len(WIDTHS) * FILTERS, len(langs)
    m = Model(langs, [rng.normal(0, 0.3, (w, 257, FILTERS)).astype(np.float32) for w in WIDTHS],
              np.zeros(k, np.float32), rng.normal(0, 0.3, (k, c)).astype(np.float32),
              np.zeros(c, np.float32))
    params = [*m.tables, m.bias, m.dense, m.out]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step, column = 0, np.arange(FILTERS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            x, y = windows[order[a:a + BATCH]], labels[order[a:a + BATCH]]
            best, value = [], []
            for t in m.tables:
                conv = convolve(x, t)
                at = conv.argmax(axis=1)
                best.append(at)
                value.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
            pooled = np.concatenate(value, axis=1) + m.bias
            hidden = np.maximum(pooled, 0)
            z = hidden @ m.dense + m.out
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            back = (g @ m.dense.T) * (pooled > 0)
            grads = []
            for i, (w, t) in enumerate(zip(WIDTHS, m.tables)):
                gt, gb = np.zeros_like(t), back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(x, best[i] + j, 1)
                    np.add.at(gt[j], (byte, np.broadcast_to(column, byte.shape)), gb)
                grads.append(gt)
            grads += [back.sum(axis=0), hidden.T @ g, g.sum(axis=0)]
            step += 1
            for p, d, u, v in zip(params, grads, first, second):
                u += 0.1 * (d - u)
                v += 0.001 * (d * d - v)
                p -= RATE * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return m


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes in each, document of each): every byte of every text in
    exactly one window; the last of a text is padded."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][doc] + k * WINDOW
    used = np.minimum(offsets[1:][doc] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    if not len(doc):
        return np.zeros((0, WINDOW), np.uint16), used, doc
    x = data.take(at, mode="clip").astype(np.uint16)
    x[np.arange(WINDOW) >= used[:, None]] = PAD
    return x, used, doc


def training_windows(docs: DataFrame, held_out, text_col: str, lang_col: str, id_col: str,
                     per_language: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of the ``per_language`` rows of each language that come first by
    the hash of their id; at most WINDOWS_PER_ROW x WINDOW bytes a row."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out)
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.xxhash64(F.col(id_col)).alias("h"))
    by = W.partitionBy("lang").orderBy("h", "id")
    ids = ids.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_language)
    # bounded: per_language rows a language
    chosen = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                          F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(ids.select("id", "lang").distinct()), ["id", "lang"])

    def run(batches):
        for b in batches:
            x, _, doc = cut_windows(*text_buffer(b.column(1)))
            count = np.bincount(doc, minlength=b.num_rows) if len(doc) else np.zeros(0, int)
            rows = np.concatenate([[], *(
                o + np.unique(np.linspace(0, n - 1, min(n, WINDOWS_PER_ROW)).astype(int))
                for o, n in zip((np.cumsum(count) - count).tolist(), count.tolist()) if n)])
            rows = rows.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc[rows])),
                 pa.array([w.tobytes() for w in x[rows]], pa.binary())], ["lang", "x"])

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    place = {v: i for i, v in enumerate(langs)}
    raw = got["x"].to_pylist()
    order = sorted(range(len(raw)), key=raw.__getitem__)   # the same order in every run
    lang = got["lang"].to_pylist()
    x = np.frombuffer(b"".join(raw[i] for i in order), np.uint16).reshape(-1, WINDOW)
    return x, np.array([place[lang[i]] for i in order], np.int64), langs


def fit(docs: DataFrame, held_out, text_col: str = "text", lang_col: str = "lang",
        id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model of the labelled rows that are not held out; None without any."""
    x, y, langs = training_windows(docs, held_out, text_col, lang_col, id_col, per_language)
    return train(x.astype(np.intp), y, langs) if len(x) else None


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text",
                  lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    letter = free_name(docs, "has_letter")
    rows = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return (docs.withColumn(lang_name, F.lit("und"))
                .withColumn(score_name, F.lit(0.0).cast("double")))
    at = rows.columns.index(text_col)
    names = [*docs.columns, lang_name, score_name]
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()),
                           T.StructField(score_name, T.DoubleType())])

    def run(batches):
        for b in batches:
            step = max(1, int(b.num_rows * SLICE_BYTES / max(1, b.get_total_buffer_size())))
            for a in range(0, b.num_rows, step):
                s = b.slice(a, step)
                x, used, doc = cut_windows(*text_buffer(s.column(at)))
                p = probabilities(model, x).astype(np.float64) * used[:, None]
                mean = np.zeros((s.num_rows, len(model.langs)))
                np.add.at(mean, doc, p)
                mean /= np.maximum(1, np.bincount(doc, used, s.num_rows))[:, None]
                ok = s.column(s.num_columns - 1).to_numpy(zero_copy_only=False)
                best = mean.argmax(axis=1)
                lang = [model.langs[i] if k else "und" for i, k in zip(best.tolist(), ok)]
                score = np.where(ok, np.minimum(mean.max(axis=1), 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:-1], pa.array(lang, pa.string()), pa.array(score)],
                    names=names)

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learnt from the rows
    that are not held out."""
    fold = held_out()
    model = fit(docs, fold)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    out = with_language(rows, model)
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language the network recognises: not ``und`` and with a
    mean probability of ``min_score`` at least; all columns unchanged."""
    model = fit(docs, held_out())
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    out = with_language(docs, model, lang_name=lang, score_name=score)
    return out.where((F.col(lang) != "und") & (F.col(score) >= min_score)).drop(lang, score)

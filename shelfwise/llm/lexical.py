"""Ranked lexical search: term-at-a-time over short lists, then
document-at-a-time over long ones.

Every document is cut into terms once; what the items ask for is kept as
inverted lists of slices of documents, in blocks of ``WINDOW`` documents with
the greatest contribution of each block.  For an item and a slice, the short
lists are read whole and summed into accumulators (term at a time).  These
accumulators then count as one more list with a bound of its own in the second
phase: documents are taken in order, a window is skipped where the bounds of
all lists do not reach the k-th best score so far, lists that cannot lift a
document over it by themselves give no candidates, and the remaining lists are
read only while a candidate can still reach it (document at a time).  Bounds
are compared strictly, so ties are kept and every result is exact.

A task carries the best of an item from slice to slice and returns k rows an
item; the best of all tasks are ranked in Spark.  Items are taken in blocks of
bounded size, each with one pass over the documents.  Weights need the
statistics of the whole corpus, so lists are written first and counted from
there.

Defined results: a null or empty text has no terms; an item without terms, or
without a document of score above 0, gives no row; repeated documents and items
are ranked each; equal scores go by doc_id, a null one last; empty tables give
an empty result; extra columns play no part.  A very long text is cut into
terms in pieces of bounded size, and counts as one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .packing import slices
from .textbytes import lower_ascii, text_buffer

TOP = 50
SLICE_BYTES = 8 << 20      # texts of one slice of the index
PIECE_BYTES = 2 << 20      # text bytes cut into terms at a time
WINDOW = 256               # documents of a block of an inverted list
SHORT_SHARE = 32           # a list is short if it holds one document in so many, or fewer
BLOCK_TERMS = 200_000      # item terms searched for in one pass over the documents

INDEX_SCHEMA = ("doc_ids array<long>, n binary, terms binary, sizes binary, docs binary, "
                "tfs binary, holding long, total long")
# Bytes of a term are digits, ASCII letters and all beyond ASCII.
TERM_BYTE = np.zeros(256, bool)
for _a, _z in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM_BYTE[_a:_z + 1] = True


def pieces(data: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end where no term goes on."""
    a, n = 0, len(data)
    while a < n:
        b = a + limit
        while b < n:
            stop = np.flatnonzero(~TERM_BYTE[data[b:b + 4096]])
            if len(stop):
                b += int(stop[0])
                break
            b += 4096
        yield a, min(b, n)
        a = min(b, n)


def terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(document of each term, terms as bytes) of the texts, piece by piece."""
    edges = offsets[1:-1]
    for a, b in pieces(data):
        part = lower_ascii(data[a:b])
        solid = TERM_BYTE[part]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = edges[(edges > a) & (edges < b)] - a      # a text's edge ends and begins a term
        begin[inner], end[inner - 1] = solid[inner], solid[inner - 1]
        start = np.flatnonzero(begin)
        if not len(start):
            continue
        # terms and the gaps between them, as one array without a copy
        both = np.empty(2 * len(start), np.int32)
        both[::2], both[1::2] = start, np.flatnonzero(end) + 1
        words = pa.Array.from_buffers(pa.binary(), len(both) - 1,
                                      [None, pa.py_buffer(both), pa.py_buffer(part)])
        yield np.searchsorted(offsets, start + a, side="right") - 1, words


def invert(data: np.ndarray, offsets: np.ndarray, vocabulary: pa.Array):
    """(terms of each document, keys, counts): a key is term * documents +
    document, in order, for the terms of the vocabulary."""
    n_docs = len(offsets) - 1
    n, keys, counts = np.zeros(n_docs, np.int64), [], []
    for doc, words in terms(data, offsets):
        n += np.bincount(doc, minlength=n_docs)
        at = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy()[::2]
        known = at >= 0
        k, c = np.unique(at[known].astype(np.int64) * n_docs + doc[known], return_counts=True)
        keys.append(k)
        counts.append(c)
    if len(keys) > 1:       # a document may go on in the next piece
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        return n, key, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
    return n, *((keys[0], counts[0]) if keys else (np.zeros(0, np.int64),) * 2)


def build_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """One row a slice of documents: their ids and term counts, and inverted
    lists (term, size, then documents and counts) of the vocabulary's terms."""

    def run(batches):
        known = pa.array(vocabulary, pa.binary())
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                n, key, tf = invert(*text_buffer(b.column(1)), known)
                term, doc = key // max(1, b.num_rows), key % max(1, b.num_rows)
                first = np.flatnonzero(np.diff(term, prepend=-1))
                binary = [x.astype(kind).tobytes() for x, kind in (
                    (n, "<i8"), (term[first], "<i4"), (np.diff(first, append=len(term)), "<i4"),
                    (doc, "<i4"), (tf, "<i4"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                     *[pa.array([x], pa.binary()) for x in binary],
                     pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
                    ["doc_ids", "n", "terms", "sizes", "docs", "tfs", "holding", "total"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage(rows.mapInArrow(run, INDEX_SCHEMA), "lexical-index", codec="zstd")


def statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all, documents of each vocabulary term).
    One number for each term of the block of items reaches the driver."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                df[np.frombuffer(t, "<i4")] += np.frombuffer(s, "<i4")
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    sums = index.agg(F.sum("holding"), F.sum("total")).first()
    got = (index.select("terms", "sizes").mapInArrow(run, "term long, df long")
           .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
    df = np.zeros(n_terms, np.int64)
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    return int(sums[0] or 0), int(sums[1] or 0), df


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1)))
                     for x in df.tolist()], np.int64)


class Slice:
    """The inverted lists of one slice, with what each posting adds before its
    term's weight, in blocks of WINDOW documents."""

    def __init__(self, row: dict, n_docs: int, total: int):
        n = np.frombuffer(row["n"], "<i8")
        self.docs = np.frombuffer(row["docs"], "<i4")
        tf = np.frombuffer(row["tfs"], "<i4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<i4")
        size = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        self.doc_ids, self.n_windows = row["doc_ids"], -(-len(n) // WINDOW)
        if len(n) and int(n.max()) * n_docs * 50 >= 1 << 63:
            long = np.array([50 * x * n_docs // total for x in n.tolist()], np.int64)
        else:
            long = 50 * n * n_docs // max(1, total)
        self.value = (10 ** 9 * tf) // (1000 * tf + 20 * (50 + long[self.docs]))
        self.edge = np.concatenate(([0], np.cumsum(size)))
        # blocks: postings of one list in one window
        block = np.repeat(np.arange(len(size)), size) * self.n_windows + self.docs // WINDOW
        self.cut = np.flatnonzero(np.diff(block, prepend=-1))
        self.best = (np.maximum.reduceat(self.value, self.cut) if len(self.cut)
                     else np.zeros(0, np.int64))
        self.block = block[self.cut]
        self.cut = np.append(self.cut, len(block))

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the wanted terms that the slice has, their list numbers)."""
        at = np.searchsorted(self.terms, wanted)
        have = at < len(self.terms)
        have[have] = self.terms[at[have]] == wanted[have]
        return np.flatnonzero(have), at[have]


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), []

    def floor(self) -> int:
        """What a document needs to be among them: at least this score."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: list) -> None:
        score, doc = np.concatenate((self.score, score)), self.doc + doc
        ids = np.array([0 if d is None else d for d in doc], np.int64)
        order = np.lexsort((ids, [d is None for d in doc], -score))[:self.k]
        self.score, self.doc = score[order], [doc[i] for i in order.tolist()]


def search(part: Slice, wanted: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Bring the documents of a slice into ``best`` of an item, whose distinct
    terms are ``wanted`` with their weights."""
    place, at = part.lists(wanted)
    w = weight[place]
    use = w > 0
    w, at = w[use], at[use]
    if not len(at):
        return
    n_docs = len(part.doc_ids)
    size = part.edge[at + 1] - part.edge[at]
    short = size <= max(1, n_docs // SHORT_SHARE)

    # term at a time: the short lists become one list of summed accumulators
    acc = np.zeros(part.n_windows * WINDOW, np.int64)
    for x, i in zip(w[short].tolist(), at[short].tolist()):
        a, b = part.edge[i], part.edge[i + 1]
        acc[part.docs[a:b]] += x * part.value[a:b]
    rows = acc.reshape(part.n_windows, WINDOW)

    # bounds of every list in every window; the accumulators are the last list
    w, at = w[~short], at[~short]
    bound = np.zeros((len(at) + 1, part.n_windows), np.int64)
    first = np.zeros((len(at), part.n_windows), np.int64)
    for j, (x, i) in enumerate(zip(w.tolist(), at.tolist())):
        lo, hi = np.searchsorted(part.block, (i * part.n_windows, (i + 1) * part.n_windows))
        window = part.block[lo:hi] - i * part.n_windows
        bound[j, window], first[j, window] = x * part.best[lo:hi], np.arange(lo, hi)
    bound[-1] = rows.max(axis=1)

    # document at a time, a window of documents together
    reach = bound.sum(axis=0)
    for v in range(part.n_windows):
        need = best.floor()
        if reach[v] < need:
            continue
        limit = bound[:, v]
        order = np.argsort(limit, kind="stable")
        below = np.cumsum(limit[order])         # what the lists up to each can add at most
        order, below = order[::-1].tolist(), below[::-1].tolist()
        score, alive = None, None
        for j, most in zip(order, below):
            if limit[j] == 0:
                break
            if score is None:
                score = np.zeros(WINDOW, np.int64)
            if alive is None:
                if most < need:         # no document beyond those met can reach it
                    alive = score > 0
            if alive is not None:
                alive &= score + most >= need
                if not alive.any():
                    break
            if j == len(at):
                score += rows[v] if alive is None else rows[v] * alive
            else:
                a, b = part.cut[first[j, v]], part.cut[first[j, v] + 1]
                doc, add = part.docs[a:b] - v * WINDOW, int(w[j]) * part.value[a:b]
                if alive is not None:
                    keep = alive[doc]
                    doc, add = doc[keep], add[keep]
                score[doc] += add
        if score is None:
            continue
        found = np.flatnonzero(score >= need if alive is None else alive & (score >= need))
        if len(found):
            best.add(score[found], [part.doc_ids[v * WINDOW + d] for d in found.tolist()])


def item_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, terms): the distinct terms of every item, staged."""

    def run(batches):
        for b in batches:
            got = [set() for _ in range(b.num_rows)]
            for doc, words in terms(*text_buffer(b.column(1))):
                for d, t in zip(doc.tolist(), words.to_pylist()[::2]):
                    got[d].add(t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted(x) for x in got], pa.list_(pa.binary()))],
                ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInArrow(run, "item_id long, terms array<binary>")
    return stage(out.withColumn("row", F.monotonically_increasing_id()), "lexical-items")


def rank_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """(row, doc_id, score): the k best documents of each task for each of the
    items of the block, (row, terms)."""
    vocabulary = sorted({t for _, ts in block for t in ts})
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = [(row, np.array(sorted(place[t] for t in ts), np.int64)) for row, ts in block]
    index = build_index(docs, vocabulary)
    n_docs, total, df = statistics(index, len(vocabulary))
    weight = term_weights(n_docs, df)

    def run(batches):
        best = [Best(k) for _ in asked]
        for b in batches:
            for row in b.to_pylist():
                part = Slice(row, n_docs, total)
                for (_, wanted), mine in zip(asked, best):
                    search(part, wanted, weight[wanted], mine)
        for (row, _), mine in zip(asked, best):
            if mine.doc:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(mine.doc), pa.int64()), pa.array(mine.doc, pa.int64()),
                     pa.array(mine.score)], ["row", "doc_id", "score"])

    found = index.select("doc_ids", "n", "terms", "sizes", "docs", "tfs").mapInArrow(
        run, "row long, doc_id long, score long")
    return stage(found, "lexical-best")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP,
         block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    asked = item_terms(items)
    terms_of_all = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-terms_of_all // block_terms))
    found = None
    for n in range(blocks):     # each block is bounded, whatever the number of items
        mine = asked.where((F.pmod(F.xxhash64("row"), F.lit(blocks)) == n) & (F.size("terms") > 0))
        block = [(r["row"], [bytes(t) for t in r["terms"]])
                 for r in mine.select("row", "terms").collect()]
        if block:
            part = rank_block(docs, block, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.where("false").select(
            "item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
            F.lit(0).cast("long").alias("score"))
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select(
        "item_id", "rank", "doc_id", "score")

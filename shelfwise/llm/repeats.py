"""Removal of repeated passages by distributed prefix doubling.

Which 400-byte strings of the corpus start more than once?  A suffix array
would answer it, and prefix doubling builds one by sorting (position, rank)
pairs at growing offsets until ranks are unique or past the threshold.  Here
it runs on anchors: the anchor of a start i is the least 16-byte hash among
the first 256 positions from i, so equal strings have their anchors at equal
places, and about one position in 130 is one.  An anchor stands for the run of
starts that share it.

* Round t ranks the anchors by their first 72 * 2**t bytes: a pair of the rank
  so far and the fingerprint of as many bytes again.  Anchors whose rank is
  unique leave; the others go on.  After 144 bytes every start of a run still
  has the ranked bytes within its 400.
* Past that, a run is ranked by the bytes of all its strings together.  A
  repeated one is covered as a whole; where ranks still differ within a group,
  the runs are cut into blocks of 16 starts and at last into single starts,
  and one run of each rank stands for its equals.  The group of a block is the
  385 bytes that all its strings share, so what is unique by then leaves.

All rounds are Spark aggregates and semi-joins on ranks: equal ranks are
counted within the tasks first, so a passage that a third of the documents
share travels as one row per task.

Defined results: a null text is empty; texts under 400 bytes keep everything;
a repeated row is another place of the same text, so both lose what is long
enough; matches never cross documents; an empty table gives an empty result;
extra columns are ignored.  Equal means equal in 128 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .textbytes import MIX_B, mix64, powers, text_buffer

THRESHOLD = 400
GRAM = 16                  # bytes whose hash elects an anchor
REACH = 256                # positions an anchor is elected from, a power of two
FIRST = 72                 # bytes of the first rank
ROUNDS = 2                 # ranks of 72 and 144 bytes
BLOCK = 16                 # starts in a block, between whole runs and single starts
PIECE = 2 << 20            # bytes handled at a time
PLACE_BITS = np.uint64(24)

KEY = ["doc_id", "th"]     # a text: its id and the hash of its bytes


class SpanHash:
    """Hash of any span of a buffer from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n + 1)[:n], out=self.sum[1:])
        self.back = powers(n + 1, inverse=True)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sum[b] - self.sum[a]) * self.back[a]
                     + (b - a).astype(np.uint64) * MIX_B)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, threshold: int):
    """(document, anchor, first start, last start, span hash) of every run of
    starts with one anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if n < threshold or not (size >= threshold).any():
        return none, none, none, none, None
    span = SpanHash(data)
    at = np.arange(n - GRAM + 1)
    gram = mix64((span.sum[GRAM:] - span.sum[:n - GRAM + 1]) * span.back[:n - GRAM + 1])
    low = ((gram >> PLACE_BITS) << PLACE_BITS) | at.astype(np.uint64)
    reach = 1
    while reach < REACH:                 # least of 2, 4, .. REACH positions
        low = np.minimum(low[:len(low) - reach], low[reach:])
        reach *= 2
    start = np.arange(len(low))
    doc = np.searchsorted(offsets, start, side="right") - 1
    ok = start + threshold <= offsets[doc + 1]
    start, doc = start[ok], doc[ok]
    anchor = (low[ok] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return doc[first], anchor[first], start[first], start[last], span


def pieces(batch: pa.RecordBatch, text_at: int, overlap: int):
    """(rows of the piece, data, offsets, start of the piece in its document):
    rows together up to PIECE bytes; a longer text alone, in overlapping
    pieces in which every start has its whole string."""
    data, offsets = text_buffer(batch.column(text_at))
    group = np.cumsum(np.diff(offsets)) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        lo, hi = offsets[a], offsets[b]
        if hi - lo <= 4 * PIECE:
            yield np.arange(a, b), data[lo:hi], offsets[a:b + 1] - lo, 0
            continue
        for r in range(a, b):
            for at in range(int(offsets[r]), int(offsets[r + 1]), PIECE):
                end = min(int(offsets[r + 1]), at + PIECE + overlap)
                yield (np.array([r]), data[at:end], np.array([0, end - at]),
                       at - int(offsets[r]))


def anchors(docs: DataFrame, threshold: int) -> DataFrame:
    """Staged (doc_id, th, p, a, b, f0, f1, u): anchor, first and last start,
    the fingerprints the ranks are made of, and that of all bytes of the run."""

    def run(batches):
        names = ["doc_id", "th", "p", "a", "b", "f0", "f1", "u"]
        for batch in batches:
            for rows, data, offsets, at in pieces(batch, 2, threshold - 1):
                doc, p, a, b, span = anchor_runs(data, offsets, threshold)
                if span is None:
                    continue
                row = pa.array(rows[doc])
                base = offsets[doc] - at
                prints = [span(p, p + FIRST), span(p + FIRST, p + 2 * FIRST),
                          span(a, b + threshold)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row),
                     *(pa.array(x - base) for x in (p, a, b)),
                     *(pa.array(x.view(np.int64)) for x in prints)], names)

    kind = ("doc_id long, th long, p long, a long, b long, f0 long, f1 long, u long")
    return stage(docs.mapInArrow(run, kind), "anchors")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): null ids and texts made plain, so that they join."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("doc_id"),
                       F.xxhash64(text).alias("th"), text.alias("text"))


def not_unique(rows: DataFrame, rank: str) -> DataFrame:
    """The rows whose rank another row has too."""
    often = rows.groupBy(rank).agg(F.count("*").alias("n")).where("n > 1").select(rank)
    return rows.join(often, rank, "left_semi")


def doubling(rows: DataFrame) -> DataFrame:
    """Anchors that are still not unique after the last rank, with it (cls)."""
    rows = rows.withColumnRenamed("f0", "cls")
    rows = stage(not_unique(rows, "cls"), "ranks")
    for t in range(1, ROUNDS):
        rows = rows.withColumn("cls", F.xxhash64("cls", f"f{t}"))
        rows = stage(not_unique(rows, "cls"), "ranks")
    return rows.select(*KEY, "p", "a", "b", "cls", "u")


def settle(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(covered runs, runs to be cut further) of the rows (key, p, a, b, cls,
    u, open).  Of each rank (cls, u) one row goes on, and only in groups where
    an open row stands alone with its rank."""
    ranks = stage(runs.groupBy("cls", "u").agg(
        F.count("*").alias("n"), F.max("open").alias("open"),
        F.min(F.struct(*KEY, "p", "a", "b")).alias("r")), "run-ranks")
    lone = F.when((F.col("n") == 1) & F.col("open"), 1).otherwise(0)
    unsettled = (ranks.groupBy("cls").agg(F.count("*").alias("m"), F.sum(lone).alias("k"))
                 .where("m > 1 AND k > 0").select("cls"))
    covered = runs.where("open").join(ranks.where("n > 1").select("cls", "u"), ["cls", "u"],
                                      "left_semi").select(*KEY, "a", "b")
    rest = (ranks.join(unsettled, "cls", "left_semi")
            .select("r.*", "cls", ((F.col("n") == 1) & F.col("open")).alias("open")))
    return covered, rest


def cut_runs(runs: DataFrame, texts: DataFrame, block: int, threshold: int) -> DataFrame:
    """The runs cut into blocks of starts, aligned to the anchor, with the
    hash of each block's bytes (u) and of those that all strings of the whole,
    unclipped block share (cls); staged."""
    per_text = runs.groupBy(*KEY).agg(F.collect_list(F.struct("p", "a", "b", "open"))
                                      .alias("runs"))

    def run(batches):
        names = [*KEY, "p", "a", "b", "cls", "u", "open"]
        for batch in batches:
            for i in range(batch.num_rows):
                got = batch.column(3).slice(i, 1).flatten()
                p, a, b = (got.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
                           for c in range(3))
                flag = got.field(3).to_numpy(zero_copy_only=False)
                # block q holds the starts p - block * q - (block - 1) .. p - block * q
                first, last = (p - b) // block, (p - a) // block
                count = last - first + 1
                r = np.repeat(np.arange(len(p)), count)
                q = first[r] + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                lo = np.maximum(a[r], p[r] - block * q - (block - 1))
                hi = np.minimum(b[r], p[r] - block * q)
                data, _ = text_buffer(batch.column(2).slice(i, 1))
                u, core = np.empty(len(r), np.uint64), np.empty(len(r), np.uint64)
                low = p[r] - block * q               # last start of the whole block
                part = lo // PIECE
                for k in np.unique(part).tolist():   # a long text in pieces
                    here = np.flatnonzero(part == k)
                    at = int(lo[here].min())
                    span = SpanHash(data[at:int(hi[here].max()) + threshold])
                    u[here] = span(lo[here] - at, hi[here] + threshold - at)
                    core[here] = span(low[here] - at, low[here] - at + threshold - block + 1)
                row = pa.array(np.full(len(r), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row),
                     *(pa.array(x) for x in (p[r], lo, hi)), pa.array(core.view(np.int64)),
                     pa.array(u.view(np.int64)), pa.array(flag[r])], names)

    kind = ("doc_id long, th long, p long, a long, b long, cls long, u long, open boolean")
    rows = texts.join(per_text, KEY).select(*KEY, "text", "runs")
    return stage(rows.mapInArrow(run, kind), "runs")


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): (doc_id, th, start, end) of covered bytes, overlapping,
    and the distinct texts that any span may lie in, both keyed."""
    if threshold < REACH + 2 * FIRST:
        raise ValueError(f"threshold must be {REACH + 2 * FIRST} bytes at least")
    rows = keyed(docs)
    runs = doubling(anchors(rows, threshold)).withColumn("open", F.lit(True))
    held = runs.select(*KEY).distinct()
    texts = stage(rows.join(held, KEY, "left_semi").groupBy(*KEY)
                  .agg(F.first("text").alias("text")), "repeat-texts")
    covered, rest = settle(runs)
    in_blocks, rest = settle(cut_runs(rest, texts, BLOCK, threshold))
    single = cut_runs(rest, texts, 1, threshold)       # a start's rank is its cls
    alone = not_unique(single, "u").where("open").select(*KEY, "a", "b")
    spans = covered.union(in_blocks).union(alone)
    return spans.select(*KEY, F.col("a").alias("start"),
                        (F.col("b") + threshold).alias("end")), texts


def cut_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, th, n_removed, spans, kept): each text with a span, its merged
    spans and its remaining bytes."""
    per_text = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches):
        for batch in batches:
            removed, merged, kept = [], [], []
            for i in range(batch.num_rows):
                data, _ = text_buffer(batch.column(2).slice(i, 1))
                got = batch.column(3).slice(i, 1).flatten()
                start, end = (got.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                removed.append(int(gone.sum()))
                merged.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                 pa.array(merged, pa.list_(pa.struct([("start", pa.int64()),
                                                      ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], [*KEY, "n_removed", "spans", "kept"])

    kind = ("doc_id long, th long, n_removed long, spans array<struct<start:long,end:long>>, "
            "kept binary")
    return texts.join(per_text, KEY).select(*KEY, "text", "spans").mapInArrow(run, kind)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.  Texts
    without a span are hashed where they are scanned and never move."""
    spans, texts = repeated_spans(docs, threshold)
    cut = cut_spans(spans, texts).select(
        F.col("doc_id").alias("k"), F.col("th").alias("kth"), "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = docs.select(
        F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("k"),
        F.xxhash64(text).alias("kth"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("whole"))
    return (every.join(cut, ["k", "kth"], "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                    F.coalesce("sha", "whole").alias("kept_sha256")))

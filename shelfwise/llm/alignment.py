"""Alignment of two tokenizers over the same texts.

Both tokenizers cut the same bytes, so tokens are aligned by where they begin.
Each slice of documents becomes two frames of token starts, and pandas
``merge_asof``, keyed by document, finds for the start of every token the token
of the other side that covers it.  The union of both directions is all
overlapping pairs (a pair whose starts are equal is found twice and kept once),
and where starts are equal the tokens before have equal ends: there a group
closes.

How many documents hold a pair of ids linked is a count over the corpus, so
links are written first, as places in the slice's own list of distinct pairs;
the lists alone are counted, and the counts are brought back to the lists, by a
broadcast table if the corpus has few enough pairs and else by a join.

Defined results: a document whose text is null or empty, or whose tokens do not
spell a space and the text, has no tokens: zeros and an empty hash.  Repeated
documents count each; an empty table gives an empty result; extra columns play
no part.  A very long text is cut where both tokenizers must cut (a space
between two words), and its parts are aligned one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .textbytes import text_buffer
from .wordids import PieceEncoder, byte_bpe, piece_bpe, word_cuts

SLICE_BYTES = 2 << 20          # text bytes aligned at a time
PAIR_BITS = 16                 # bits of an id of the second side within a pair
PAIRS_BROADCAST = 4_000_000    # distinct pairs whose counts are broadcast (some 50 MB)
FLUSH = 2_000_000              # distinct pairs a task gathers before it passes their counts on

SLICE_SCHEMA = ("slice long, row array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, "
                "n_groups array<long>, n_links array<long>, distinct array<long>, "
                "groups_sha256 array<string>, pairs binary, docs binary, places binary, times binary")


@dataclass
class Part:
    """Texts aligned together: whole documents, or a piece of one long one."""
    rows: np.ndarray           # row of each text in the partition
    doc_ids: pa.Array
    texts: pa.Array            # a space and the text
    first: bool = True         # the text begins and ends here
    last: bool = True


@dataclass
class Aligned:
    """Tokens of both sides in order, by text; texts that are not spelt by
    their tokens have none."""
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray            # tokens of each text
    n_b: np.ndarray
    group_a: np.ndarray        # group of each token, counted over all texts
    group_b: np.ndarray
    link_a: np.ndarray         # overlapping pairs, as places in a and b
    link_b: np.ndarray


def _tokens(enc: PieceEncoder, spell: np.ndarray, texts: pa.Array):
    """(ids, bytes of each, tokens of each text, whether they spell the text)."""
    data, offsets = text_buffer(texts)
    code, text = enc.codes(data, offsets)
    good = np.bincount(text, ~enc.faithful[code], len(texts)) == 0
    ids = enc.gather(code)
    return ids, spell[ids], np.bincount(text, enc.size[code], len(texts)).astype(np.int64), good


def align(texts: pa.Array, side_a, side_b, valid: np.ndarray | None = None) -> Aligned:
    """Align the tokens of texts that all begin with a space.  A side is an
    encoder and the number of bytes of each of its ids."""
    a, len_a, n_a, good = _tokens(*side_a, texts)
    b, len_b, n_b, good_b = _tokens(*side_b, texts)
    good &= good_b
    if valid is not None:
        good &= valid
    keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
    a, len_a, b, len_b = a[keep_a], len_a[keep_a], b[keep_b], len_b[keep_b]
    n_a, n_b = n_a * good, n_b * good
    doc = np.arange(len(texts))
    # bytes of all texts in one row: a place names a text and a byte of it
    left = pd.DataFrame({"doc": np.repeat(doc, n_a), "at": np.cumsum(len_a) - len_a,
                         "i": np.arange(len(a))})
    right = pd.DataFrame({"doc": np.repeat(doc, n_b), "at": np.cumsum(len_b) - len_b,
                          "j": np.arange(len(b))})
    if not len(a):
        none = np.zeros(0, np.int64)
        return Aligned(a, b, n_a, n_b, none, none, none, none)
    over_a = pd.merge_asof(left, right, on="at", by="doc")["j"].to_numpy().astype(np.int64)
    over_b = pd.merge_asof(right, left, on="at", by="doc")["i"].to_numpy().astype(np.int64)
    at_a, at_b = left["at"].to_numpy(), right["at"].to_numpy()
    same_a, same_b = at_a == at_b[over_a], at_b == at_a[over_b]
    more = np.flatnonzero(~same_b)          # equal starts were found from the other side
    return Aligned(a, b, n_a, n_b, np.cumsum(same_a) - 1, np.cumsum(same_b) - 1,
                   np.concatenate((left["i"].to_numpy(), over_b[more])),
                   np.concatenate((over_a, more)))


def group_text(x: Aligned) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of all texts, one after the other, and where each
    text's begins and the last ends."""
    if not len(x.a):
        return b"", np.zeros(len(x.n_a) + 1, np.int64)
    n_groups = int(x.group_a[-1]) + 1
    size_a = np.bincount(x.group_a, minlength=n_groups)
    size_b = np.bincount(x.group_b, minlength=n_groups)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    # a token stands behind its own side's and the other side's of the groups before
    at_a = np.arange(len(x.a)) + (end_b - size_b)[x.group_a]
    at_b = np.arange(len(x.b)) + end_a[x.group_b]
    ids = np.empty(len(x.a) + len(x.b), np.int64)
    ids[at_a], ids[at_b] = x.a, x.b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[at_a[end_a - 1]], mark[at_b[end_b - 1]] = ord("|"), ord(";")
    digits = 1 + (ids > 9) + (ids > 99) + (ids > 999) + (ids > 9999) + (ids > 99999)
    begin = np.cumsum(digits + 1) - digits - 1
    out = np.empty(int(begin[-1] + digits[-1]) + 1, np.uint8)
    rest = ids
    for k in range(int(digits.max())):      # digits from the last one on
        on = np.flatnonzero(digits > k)
        out[begin[on] + digits[on] - 1 - k] = 48 + rest[on] % 10
        rest = rest // 10
    out[begin + digits] = mark
    edge = np.concatenate(([0], np.cumsum(x.n_a + x.n_b)))
    return out.tobytes(), np.append(begin, len(out))[edge]


def parts(batch: pa.RecordBatch, row: int, limit: int) -> Iterator[Part]:
    """The documents of a batch (doc_id, text) as parts of about ``limit``
    bytes.  Documents without a text have none in theirs."""
    texts = batch.column(1)
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
    # an empty text has no tokens, not those of the space
    spaced = pc.if_else(pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0), pa.scalar(""), spaced)
    size = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    for i in [*np.flatnonzero(size > limit).tolist(), batch.num_rows]:
        # whole documents up to the next long one
        group = np.cumsum(size[begin:i]) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), i - begin]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield Part(row + np.arange(begin + a, begin + b),
                           batch.column(0).slice(begin + a, b - a), spaced.slice(begin + a, b - a))
        if i < batch.num_rows:
            data, _ = text_buffer(spaced.slice(i, 1))
            cuts = word_cuts(data)
            near = np.searchsorted(cuts, np.arange(limit, len(data), limit))
            edges = [0, *np.unique(cuts[near[near < len(cuts)]], return_counts=True)[0].tolist(),
                     len(data)]
            raw = data.tobytes()
            for a, b in zip(edges, edges[1:]):
                yield Part(np.array([row + i]), batch.column(0).slice(i, 1),
                           pa.array([raw[a:b].decode()], pa.string()), a == 0, b == len(data))
        begin = i + 1


def sides(path_a: str | None, path_b: str | None):
    from .wordids import kept

    def lengths(enc, key):
        return kept(f"lengths {key}", lambda: np.array(
            [len(enc.joined([i])) for i in range(enc.vocabulary)], np.int64))

    a, b = byte_bpe(path_a, special=True), piece_bpe(path_b)
    return (a, lengths(a, f"a {path_a}")), (b, lengths(b, f"b {path_b}"))


def _spelt(chunks: list[Part], side_a, side_b) -> bool:
    """All parts of a long text are spelt by their tokens on both sides."""
    return all(_tokens(*side, p.texts)[3].all() for p in chunks for side in (side_a, side_b))


def aligned_parts(batches, side_a, side_b, limit: int) -> Iterator[tuple[Part, Aligned]]:
    """Every part of a task with its alignment; a long text has tokens in all
    of its parts or in none."""
    row, chunks = 0, []
    for batch in batches:
        for p in parts(batch, row, limit):
            if p.first and p.last:
                yield p, align(p.texts, side_a, side_b)
                continue
            chunks.append(p)
            if p.last:
                good = np.array([_spelt(chunks, side_a, side_b)])
                for c in chunks:
                    yield c, align(c.texts, side_a, side_b, good)
                chunks = []
        row += batch.num_rows


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The alignment itself, a row for each part of a document: ids of both
    sides, the group of each token (groups of a part count from 0) and the
    overlapping pairs as places in ``a`` and ``b``.  ``part`` counts the parts
    of a long document."""

    def run(batches):
        side_a, side_b = sides(path_a, path_b)
        number = 0
        for p, x in aligned_parts(batches, side_a, side_b, SLICE_BYTES):
            number = 0 if p.first else number + 1
            ea, eb = np.concatenate(([0], np.cumsum(x.n_a))), np.concatenate(([0], np.cumsum(x.n_b)))
            order = np.argsort(x.link_a, kind="stable")
            la, lb = x.link_a[order], x.link_b[order]
            el = np.searchsorted(la, ea)
            ga = np.append(x.group_a, 0)[np.minimum(ea[:-1], len(x.group_a))]

            def lists(values, edge, kind):
                return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, kind))

            yield pa.RecordBatch.from_arrays(
                [p.doc_ids, pa.array(np.full(len(p.rows), number, np.int32)),
                 lists(x.a.astype(np.int32), ea, pa.int32()), lists(x.b.astype(np.int32), eb, pa.int32()),
                 lists(x.group_a - np.repeat(ga, x.n_a), ea, pa.int32()),
                 lists(x.group_b - np.repeat(ga, x.n_b), eb, pa.int32()),
                 lists(la - np.repeat(ea[:-1], np.diff(el)), el, pa.int32()),
                 lists(lb - np.repeat(eb[:-1], np.diff(el)), el, pa.int32())],
                ["doc_id", "part", "a", "b", "a_group", "b_group", "link_a", "link_b"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, part int, a array<int>, b array<int>, "
                                "a_group array<int>, b_group array<int>, link_a array<int>, "
                                "link_b array<int>")


def link_slices(docs: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """One row a part: what each of its documents counts, the distinct pairs
    of ids that are linked in it (``id of a << 16 | id of b``), in how many of
    its documents each stands for the first time, and for each document the
    places of its pairs in that list (as differences) and how often each is
    linked.  Staged."""

    def run(batches):
        side_a, side_b = sides(path_a, path_b)
        if max(side_a[0].vocabulary, side_b[0].vocabulary) > 1 << PAIR_BITS:
            raise ValueError("ids beyond 16 bits")
        task, number = TaskContext.get().partitionId(), 0
        digest, seen, going = None, np.zeros(0, np.uint32), False
        for p, x in aligned_parts(batches, side_a, side_b, SLICE_BYTES):
            text, edge = group_text(x)
            if p.first and p.last:
                sha = [hashlib.sha256(text[a:b - 1]).hexdigest() if b > a else ""
                       for a, b in zip(edge.tolist(), edge[1:].tolist())]
            else:               # a long document's text goes on from part to part
                if p.first:
                    digest, seen, going = hashlib.sha256(), np.zeros(0, np.uint32), False
                if text:
                    digest.update(b";" * going + text[:-1])
                    going = True
                sha = [(digest.hexdigest() if going else "") if p.last else None]
            doc = np.repeat(np.arange(len(p.rows)), x.n_a)[x.link_a]
            pair = (x.a[x.link_a].astype(np.int64) << PAIR_BITS) | x.b[x.link_b]
            key, times = np.unique((doc << 32) | pair, return_counts=True)
            own = (key & 0xFFFFFFFF).astype(np.uint32)
            distinct, holds = np.unique(own, return_counts=True)
            if not (p.first and p.last):
                holds = holds - np.isin(distinct, seen)
                seen = np.unique(np.concatenate((seen, distinct)), return_counts=True)[0]
            place = np.searchsorted(distinct, own)
            starts = np.zeros(len(x.n_a) + 1, np.int64)
            np.cumsum(np.bincount(doc, minlength=len(x.n_a)), out=starts[1:])
            group_edge = np.searchsorted(x.group_a, np.arange(1 + (x.group_a[-1] if len(x.a) else -1)))
            groups = np.diff(np.searchsorted(group_edge, np.concatenate(([0], np.cumsum(x.n_a)))))
            counts = np.bincount(key >> 32, minlength=len(x.n_a))

            def one(values):
                return pa.array([values.tolist()], pa.list_(pa.int64()))

            def raw(values, kind):
                return pa.array([values.astype(kind).tobytes()], pa.binary())

            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | number]), one(p.rows), pa.array([p.doc_ids.to_pylist()],
                                                                          pa.list_(pa.int64())),
                 one(x.n_a), one(x.n_b), one(groups), one(np.diff(starts)), one(counts),
                 pa.array([sha], pa.list_(pa.string())),
                 raw(distinct, "<u4"), raw(holds, "<i4"), raw(np.diff(place, prepend=0), "<i4"),
                 raw(times, "<i4")],
                [f.split()[0] for f in SLICE_SCHEMA.split(", ")])
            number += 1
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage(rows.mapInArrow(run, SLICE_SCHEMA), "alignment-links", codec="zstd")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, top): documents of the corpus that hold a pair, and whether no
    other pair of its first id is held by more.  Staged."""

    def merged(pairs, counts):
        key = np.concatenate(pairs)
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate(counts)[order]
        at = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        return key[at], (np.add.reduceat(n, at) if len(at) else n)

    def run(batches):
        pairs, counts, held = [], [], 0

        def out():
            key, n = merged(pairs, counts)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pairs.append(np.frombuffer(p, "<u4").astype(np.int64))
                counts.append(np.frombuffer(n, "<i4").astype(np.int64))
                held += len(pairs[-1])
                if held > 2 * FLUSH:
                    key, n = merged(pairs, counts)
                    pairs, counts, held = [key], [n], len(key)
                    if held > FLUSH:
                        yield out()
                        pairs, counts, held = [], [], 0
        if pairs:
            yield out()

    sums = (links.select("pairs", "docs").mapInArrow(run, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0"))
    sums = stage(sums.withColumn("a", F.shiftright("pair", PAIR_BITS)), "alignment-pairs")
    best = sums.groupBy("a").agg(F.max("n").alias("most"))      # one row an id
    return stage(sums.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top")),
                 "alignment-counts")


REPORT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ROW_SCHEMA = ("task long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
              "n_best long, count_sum long, groups_sha256 string")


def _rows(row: dict, n: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
    """The documents of a part, given the count and the mark of each of its
    pairs."""
    place = np.cumsum(np.frombuffer(row["places"], "<i4"))
    times = np.frombuffer(row["times"], "<i4").astype(np.int64)
    edge = np.concatenate(([0], np.cumsum(row["distinct"]))).astype(np.int64)

    def sums(values):
        total = np.concatenate(([0], np.cumsum(values[place] * times)))
        return pa.array(total[edge[1:]] - total[edge[:-1]], pa.int64())

    k = len(row["row"])
    return pa.RecordBatch.from_arrays(
        [pa.array([row["slice"] >> 32] * k, pa.int64()), pa.array(row["row"], pa.int64()),
         *[pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
         sums(top.astype(np.int64)), sums(n), pa.array(row["groups_sha256"], pa.string())],
        [f.split()[0] for f in ROW_SCHEMA.split(", ")])


def by_broadcast(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Bounded by the caller: some 13 bytes for each distinct pair."""
    got = counts.toArrow()
    pair = got["pair"].to_numpy().astype(np.uint32)
    order = np.argsort(pair)
    table = links.sparkSession.sparkContext.broadcast(
        (pair[order], got["n"].to_numpy()[order],
         got["top"].combine_chunks().to_numpy(zero_copy_only=False)[order]))

    def run(batches):
        keys, n, top = table.value
        for b in batches:
            for row in b.to_pylist():
                at = np.searchsorted(keys, np.frombuffer(row["pairs"], "<u4"))
                yield _rows(row, n[at], top[at])

    return links.drop("docs").mapInArrow(run, ROW_SCHEMA)


def by_join(links: DataFrame, counts: DataFrame) -> DataFrame:
    """For any number of pairs: the lists of pairs are joined to the counts
    and gathered by part again, each as long as its part has pairs."""

    def pairs(batches):
        for b in batches:
            for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = np.frombuffer(p, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), s, np.int64)), pa.array(p)], ["slice", "pair"])

    known = (links.select("slice", "pairs").mapInArrow(pairs, "slice long, pair long")
             .join(counts, "pair").groupBy("slice")
             .agg(F.collect_list(F.struct("pair", "n", "top")).alias("known")))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                known = row["known"] or []
                pair = np.array([x["pair"] for x in known], np.int64)
                order = np.argsort(pair)
                yield _rows(row, np.array([x["n"] for x in known], np.int64)[order],
                            np.array([x["top"] for x in known], bool)[order])

    return links.drop("docs", "pairs").join(known, "slice", "left").mapInArrow(run, ROW_SCHEMA)


def report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
           broadcast_pairs: int = PAIRS_BROADCAST) -> DataFrame:
    """The counts of every document, see the module's contract."""
    links = link_slices(docs, path_a, path_b)
    counts = pair_counts(links)
    few = counts.count() <= broadcast_pairs
    rows = by_broadcast(links, counts) if few else by_join(links, counts)
    sums = [F.sum(c).alias(c) for c in REPORT[1:-1]]
    # a document in one part is one row already; a long one has a row a part
    return rows.groupBy("task", "row").agg(
        F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")
    ).select(*REPORT)

"""Concatenate-and-cut packing by two-pass prefix sums.

Pass one tokenises every text once and writes the ids with each row's running
start within its partition.  The token totals of the partitions (one row each)
are prefix-summed into global offsets; pass two adds them and cuts the stream
into fixed windows without moving any row.  A document that crosses a window's
end leaves a boundary record on both sides.  Only the last window can be
short, so the padding of the whole corpus is less than one window.

The ids are those of a plain call of the tokenizers library, so the name of a
special token in a text gives that token.

Defined results: a null or empty text is the single end id; repeated rows are
packed each; an empty table gives no pieces; extra columns are ignored.  Very
long texts are cut like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .textbytes import text_buffer
from .wordids import byte_bpe

WINDOW = 2048
END_ID = 1
SLICE_BYTES = 4 << 20      # texts encoded at a time

TOKEN_SCHEMA = "part int, row_start long, doc_id long, n long, ids binary"
PIECE_SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
                "sequence_id long, offset long")


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` text bytes (one row at least)."""
    size = np.array([x or 0 for x in
                     pa.compute.binary_length(batch.column(text_at)).to_pylist()], np.int64)
    if not len(size):
        return
    group = np.cumsum(size) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(size)]):
        yield batch.slice(a, b - a)


def binaries(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """The values as one binary entry for each of the counts, without a copy."""
    edge = np.concatenate(([0], np.cumsum(count))) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(count), [
        None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, row_start, doc_id, n, ids): the ids of each row, little-endian
    and as narrow as the vocabulary allows, and where they start in the
    partition's stream.  Staged, so the order of the rows is fixed."""

    def run(batches):
        enc = byte_bpe(tokenizer_path, special=False)       # a plain call's ids
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, 1):
                ids, n = enc.encode(b.column(1))
                ids = np.insert(ids, np.cumsum(n), end_id)
                n += 1
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(start), b.column(0),
                     pa.array(n), binaries(ids, n)], ["part", "row_start", "doc_id", "n", "ids"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage(rows.mapInArrow(run, TOKEN_SCHEMA), "tokens", codec="zstd")


def offsets(tokens: DataFrame) -> DataFrame:
    """(part, base): global offset of each partition's stream.  The window is
    over one row per partition, not over documents."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (little-endian
    unsigned 32 bit), doc_tokens, sequence_id, offset."""

    def run(batches):
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            begin = b.column(1).to_numpy(zero_copy_only=False)
            n = b.column(2).to_numpy(zero_copy_only=False)
            first, last = begin // window, (begin + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            lo = np.maximum(seq * window, begin[row])
            hi = np.minimum((seq + 1) * window, (begin + n)[row])
            start, length = lo - begin[row], hi - lo
            # the pieces in order are the batch's ids, cut anew
            data, _ = text_buffer(b.column(3))
            narrow = "<u2" if len(data) == 2 * int(n.sum()) else "<u4"
            ids = data.view(narrow).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length),
                 binaries(ids, length), pa.array(n[row]), pa.array(seq),
                 pa.array(lo - seq * window)], names)

    # bounded: one row of 12 bytes for each task of pass one
    rows = tokens.join(F.broadcast(offsets(tokens)), "part").select(
        "doc_id", (F.col("base") + F.col("row_start")).alias("begin"), "n", "ids")
    return rows.mapInArrow(run, PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW,
         end_id: int = END_ID) -> DataFrame:
    """All pieces of the packed corpus, see :func:`cut`."""
    return cut(tokenize(docs, tokenizer_path, end_id), window)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, n_pad): the windows themselves, padded to ``window``
    unless their length is a power of two.  A group holds one window."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    rows = pieces.groupBy("sequence_id").agg(
        F.concat_ws("", F.transform(ordered, lambda x: x["h"])).alias("h"),
        F.sum("length").alias("n"))
    whole = F.pow(F.lit(2), F.floor(F.log2("n"))) == F.col("n")
    pad = F.when(whole, 0).otherwise(F.lit(window) - F.col("n")).cast("int")
    unit = F.lit(int(pad_id).to_bytes(4, "little").hex().upper())
    return rows.select("sequence_id", F.unhex(F.concat("h", F.repeat(unit, pad))).alias("ids"),
                       pad.alias("n_pad"))


def pieces_report(docs: DataFrame, **options) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    p = pack(docs, **options)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                    "doc_tokens", "sequence_id", "offset")

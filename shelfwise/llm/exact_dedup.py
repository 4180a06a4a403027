"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text.  New documents are reduced to fingerprints (one scan of the
texts), grouped by digest with map-side combine, anti-joined with the index by
sort-merge (the index side needs no shuffle: it is bucketed by the join key)
and the fresh digests are appended.  DataFrame functions only.

Defined results: a null text counts as empty and all empty texts are one
group; among equal texts the row with the most code points, then the smallest
doc_id (null last), then the first physical row stays, so repeated rows leave
one; an empty table gives an empty result and an empty index; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, staging_path
from .rows import free_name, with_row_key, without_spaces

INDEX_BUCKETS = 64  # production parameter: files of the index, a few GB of digests each


def open_index(spark: SparkSession, path: str, buckets: int = INDEX_BUCKETS) -> str:
    """Attach the index at ``path`` (made if absent) and return its table name.

    The folder is the index: any session can attach it again, since the bucket
    of a file is part of its name."""
    name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch_id STRING)
        USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS
        LOCATION '{path}'""")
    return name


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, points, digest) of every row; the texts are read once and
    only these narrow rows travel further."""
    key = free_name(docs, "row")
    rows = with_row_key(docs, key)
    return stage(rows.select(
        F.col(key).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        F.unhex(F.sha2(without_spaces(F.col(text_col)), 256)).alias("digest")), "fingerprints")


def winners(fp: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the group's size.  The
    aggregate combines within each task first, so a group that holds a third
    of all rows travels as one row per task."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"),
                          F.col("doc_id"), F.col("row")))
    return (fp.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"),
                    F.col("best.row").alias("keep_row"), "group_size"))


def dedup_against_index(fp: DataFrame, index: str, batch_id: str) -> DataFrame:
    """Append the digests of ``fp`` that the index lacks and return one row per
    document: row, doc_id, keep_id, group_size (within the batch), kept, digest.

    A digest of an earlier batch keeps its earlier document.  A repeated
    batch_id is a replay: what it already appended is not taken for an
    earlier batch, and nothing is appended twice."""
    spark = fp.sparkSession
    best = stage(winners(fp), "winners")
    known = spark.table(index)
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {index}")
                  .where("col_name = 'Num Buckets'").first()["data_type"])
    fresh = (best.repartition(buckets, "digest")
             .join(known.select("digest").hint("merge"), "digest", "left_anti")
             .select("digest", "keep_id", F.lit(batch_id).alias("batch_id")))
    fresh.write.insertInto(index)
    earlier = (spark.table(index).where(F.col("batch_id") != batch_id)
               .select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old")))
    decided = (best.join(earlier.hint("merge"), "digest", "left")
               .select("digest", "group_size", "keep_row", "old",
                       F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id"))
                       .alias("keep_id")))
    return (fp.join(decided, "digest")
            .select("row", "doc_id", "keep_id", "group_size",
                    (F.col("old").isNull() & (F.col("row") == F.col("keep_row"))).alias("kept"),
                    "digest"))


def exact_dedup(docs: DataFrame, index_path: str | None = None, batch_id: str = "0",
                buckets: int = INDEX_BUCKETS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``index_path`` names a lasting index; without one, a new index is made in
    the shared checkpoint folder."""
    spark = docs.sparkSession
    index = open_index(spark, index_path or staging_path(spark, "digest-index"), buckets)
    out = dedup_against_index(fingerprints(docs), index, batch_id)
    return out.select("doc_id", "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, index_path: str | None = None,
                      batch_id: str = "0") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged.  Only the
    dropped rows' keys are joined back, as an anti-join."""
    spark = docs.sparkSession
    key = free_name(docs, "row")
    docs = with_row_key(docs, key)
    index = open_index(spark, index_path or staging_path(spark, "digest-index"))
    gone = (dedup_against_index(fingerprints(docs.drop(key)), index, batch_id)
            .where(~F.col("kept")).select(F.col("row").alias(key)))
    return docs.join(gone, key, "left_anti").drop(key)

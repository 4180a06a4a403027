"""A training corpus from raw documents, as five stages over the operators.

Every stage takes the documents its predecessor kept, as (spark, docs, sf_dir),
and returns a DataFrame; all but the last return the columns they were given.
``run`` writes each stage's rows as Parquet in the session's checkpoint folder
and reads them as the next one's documents, so a lost executor repeats tasks of
one stage only.

1. language ID: rows that the byte network rejects go (no letters, or no
   language it knows).
2. exact dedup: of texts equal but for white space, one row stays.
3. n-gram Jaccard join: of each group of near copies (five words, 0.8) the row
   with the smallest doc_id stays.
4. mixing: every source is taken in whole documents, up to three times, near
   its target share.
5. packing: windows of 2,048 token ids, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import byte_cnn, exact_dedup, mix_sources, ngram_join, packing
from shelfwise.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_cnn.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces_report(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_join", near),
          ("mix_sources", mix), ("packing", pack)]

# Neither the network nor the tokeniser can be written in SQL; the tests hold
# the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

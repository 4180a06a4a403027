"""Fixtures in code: small tables with the awkward cases every operator meets."""

import random
import re

from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # names that operators use inside
    T.StructField("digest", T.StringType()), T.StructField("row", T.IntegerType()),
    T.StructField("h", T.StringType()), T.StructField("n", T.StringType())])


def documents(spark, rows, path=None):
    """rows: (doc_id, text[, lang[, source]]); written when a path is given."""
    full = [tuple(r) + (None,) * (4 - len(r)) + ("x", 1, "y", None) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if path is None:
        return df
    df.repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def words(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

"""Reading the driver's parquet tables (column-pruned, filters pushed down)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The names of the given tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table.  Parquet: projections and filters on the result reach
    the scan (``ReadSchema`` / ``PushedFilters``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

"""Dense surrogate keys without a single-partition window, and keys that members
keep from one build to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def dense_key(df: DataFrame, keys: list[str], id_col: str,
              partitions: int | None = None) -> DataFrame:
    """Number the (distinct) rows of ``df`` 1..n in ``keys`` order.

    Same ids as ``row_number() OVER (ORDER BY keys ASC NULLS FIRST)``, but
    computed in parallel: rows are range-partitioned on the keys and sorted
    inside each partition, every row gets its position inside the partition
    (``monotonically_increasing_id`` minus the partition base), and a table of
    partition sizes, one row per partition, gives each partition its offset.
    The numbered rows are written once, so both uses see the same partitions.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    # without an explicit count AQE sizes the range partitions from the data
    # (merging adjacent ranges keeps them in key order)
    ranged = (df.repartitionByRange(partitions, *order) if partitions
              else df.repartitionByRange(*order))
    ranged = (ranged
              .sortWithinPartitions(*order)
              .withColumns({"__pid": F.spark_partition_id(),
                            "__mid": F.monotonically_increasing_id()}))
    ranged = stage(ranged, "ranges")
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__pid",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    return (ranged.join(offsets, "__pid")
            .withColumn(id_col, (F.col("__off") + local + 1).cast("bigint"))
            .drop("__pid", "__mid", "__off"))


def stable_key(members: DataFrame, known: DataFrame | None, keys: list[str],
               id_col: str) -> DataFrame:
    """Number the (distinct) ``members``: those in ``known`` (``id_col`` and the
    keys; NULL equals NULL) keep their id, the others follow the greatest known
    id in ``keys`` order.  Ids of members that are gone are never given again.

    One join of the members with the known keys, written once; only the new
    ones are ranged and numbered."""
    if known is None:
        return dense_key(members, keys, id_col).select(id_col, *members.columns)
    old = known.select(id_col, *[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = stage(members.join(old, same, "left").select(id_col, *members.columns), "keyed")
    if joined.where(F.col(id_col).isNull()).isEmpty():
        return joined
    top = known.agg(F.max(id_col)).first()[0] or 0
    fresh = dense_key(joined.where(F.col(id_col).isNull()).drop(id_col), keys, id_col)
    return joined.where(F.col(id_col).isNotNull()).unionByName(
        fresh.withColumn(id_col, F.col(id_col) + F.lit(top).cast("bigint")))

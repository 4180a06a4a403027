"""Incremental landing of weekly feed files with Structured Streaming.

The feeds arrive as weekly CSV drops.  Instead of re-reading the whole folder
on every rebuild, a file stream picks up only new files, cleans each
micro-batch with the same resolution and cleaning as the batch path, and
appends the cleaned rows to a parquet table, one ``batch_id`` partition per
micro-batch.  A replayed batch (after a failure) overwrites its own
partition, so the table stays exact; the stream's progress lives in the
checkpoint folder.  ``trigger(availableNow=True)`` processes what is there
and stops, which suits a weekly schedule.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SKU_DIGITS
from ..operators.clean import clean_feeds
from ..sources.feeds import KINDS, accepted, read_records


def ingest(spark: SparkSession, kind: str, folder: str, out: str, checkpoint: str,
           aliases: dict[str, DataFrame], available_now: bool = True, columns=None,
           sku_digits: int = SKU_DIGITS):
    """Start the stream for ``kind`` (``internal`` or ``competitor``);
    ``columns``: the drops' column order, if not the usual one.

    The stream says which files are new; a micro-batch reads them by records,
    as the batch path does.  The header of every file is checked against
    ``columns``: a file in another order stops the stream with an error instead
    of filling the wrong columns."""
    lines = spark.readStream.schema("value string").text(folder)

    def drops(batch: DataFrame) -> list[str]:
        """Names of the files of one micro-batch."""
        found = batch.select("file").distinct().collect()
        return sorted(unquote(r["file"]) for r in found)

    def land(batch: DataFrame, batch_id: int) -> None:
        files = drops(batch)
        if not files:
            return
        rows = accepted(read_records(batch.sparkSession, files, kind, columns or KINDS[kind]),
                        kind)
        if kind == "internal":
            clean, _ = clean_feeds(rows, None, aliases, sku_digits=sku_digits)
        else:
            _, clean = clean_feeds(None, rows, aliases)
        (clean.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out))

    new = lines.select(F.col("_metadata.file_path").alias("file"))
    w = new.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 hour")
    return w.start()

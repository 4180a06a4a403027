"""Session helpers: one place for the configuration the library relies on."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Settings every job of the library assumes.  UTC keeps week boundaries the
# same on every executor; AQE re-plans joins and shuffle sizes on runtime
# statistics (broadcast only when a measured side is small, split skewed
# partitions, coalesce tiny ones).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# Settings for a cluster run over a large history (pass as ``extra``): start
# shuffles wide and let AQE merge small partitions towards the advisory size,
# so a stage over the full fact never has partitions larger than memory;
# splits of 256 MB keep scan tasks few but bounded.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
}


def get_spark(app: str = "shelfwise", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    ``spark.checkpoint.dir`` of the session; where the cluster names none, a
    folder beside the tables of the session's warehouse, which driver and
    executors share as well.  The same rule in every mode: no machine-local
    temporary folder is ever made here.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def _stage_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stage/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    return f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df, name: str, codec: str | None = None):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: the lineage is cut (a lost executor recomputes from the written
    table, not from the raw feed), later plans stay small, and AQE sees real
    sizes.  Parquet keeps column pruning for the readers."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    w = df.write.mode("overwrite")
    (w.option("compression", codec) if codec else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(jobs: dict) -> dict:
    """Run independent driver calls at the same time, each its own Spark jobs:
    small tables do not wait for one another.  The results by name; the first
    error is raised."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        running = {k: pool.submit(f) for k, f in jobs.items()}
        return {k: r.result() for k, r in running.items()}


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a written table, in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A short text file; None where there is none."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p):
        return None
    return "".join(r.value for r in spark.read.text(path).collect()).strip()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a short text file in one step: written beside it, then renamed
    over it."""
    sc = spark.sparkContext
    fs_api = sc._jvm.org.apache.hadoop.fs
    new, old = fs_api.Path(f"{path}.{uuid.uuid4().hex}"), fs_api.Path(path)
    conf = sc._jsc.hadoopConfiguration()
    out = old.getFileSystem(conf).create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = sc._gateway.new_array(fs_api.Options.Rename, 1)
    rename[0] = getattr(fs_api, "Options$Rename").OVERWRITE
    fs_api.FileContext.getFileContext(old.toUri(), conf).rename(new, old, rename)


def clear_stages(spark: SparkSession) -> None:
    """Remove every table this application has staged.  For the end of a job:
    DataFrames read from staged tables cannot be evaluated afterwards."""
    delete_path(spark, _stage_root(spark))

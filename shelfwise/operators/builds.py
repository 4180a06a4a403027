"""The folder of a written star: builds, their keys, weeks and retention.

::

    <path>/CURRENT                 name of the current build, replaced in one step
    <path>/build-*/                dimensions, changed weeks of the facts, summary
    <path>/build-*/WEEKS/          fact, week, lines, digest, and the build that holds it
    <path>/build-*/KEYS            names of the key batches
    <path>/build-*/COMPLETE        written last
    <path>/keys/<batch>/<dim>/     ids given to new members, appended by one build

A build names all it consists of and never changes what another has written.
So the pointer switches keys, weeks and summary together; of two writers at a
time the later pointer wins whole, and what the other wrote is not referred to.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, read_text, together, write_text

POINTER, COMPLETE, KEYS, WEEKS = "CURRENT", "COMPLETE", "KEYS", "WEEKS"
KEEP = 2                   # builds that stay readable, the current one included
MERGE_AFTER = 8            # builds a fact may be spread over, and key batches x 8
ABANDONED = 7 * 86400.0    # seconds until a build that was never completed goes
WEEK_SCHEMA = "fact string, date_id bigint, lines bigint, digest string, build string"


def new_name() -> str:
    return f"build-{uuid.uuid4().hex}"


def current(spark: SparkSession, path: str) -> str | None:
    """Name of the build that the pointer names; None without one."""
    return read_text(spark, f"{path.rstrip('/')}/{POINTER}") or None


def _children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, time of change in seconds) of what lies in a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in fs.listStatus(p)]


def complete(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, time of completion) of the whole builds, newest first."""
    path, out = path.rstrip("/"), []
    for name, _ in _children(spark, path):
        if name.startswith("build-"):
            out += [(name, t) for f, t in _children(spark, f"{path}/{name}") if f == COMPLETE]
    return sorted(out, key=lambda b: (-b[1], b[0]))


# ---------------------------------------------------------------------- keys


def _batches(spark: SparkSession, path: str, name: str) -> list[str]:
    return (read_text(spark, f"{path}/{name}/{KEYS}") or "").split()


def read_keys(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame] | None:
    """The ids given to members of each dimension up to a build, members that
    are gone included; None where the build names no keys."""
    path = path.rstrip("/")
    batches = _batches(spark, path, name)
    if not batches:
        return None
    roots = [f"{path}/keys/{b}" for b in batches]
    dims = sorted(d for d, _ in _children(spark, roots[0]) if d.startswith("dim_"))
    return {d: reduce(DataFrame.unionByName, [spark.read.parquet(f"{r}/{d}") for r in roots])
            for d in dims}


def write_keys(spark: SparkSession, path: str, name: str, base: str | None,
               dims: dict[str, DataFrame], keys: dict[str, tuple[str, list[str]]]) -> None:
    """Append the members of ``dims`` that ``base`` has no id for.  Ids only
    grow, so these are the ones above its greatest.  Many batches become one."""
    batches = _batches(spark, path, base) if base else []
    known = read_keys(spark, path, base) if batches else None
    merge = len(batches) >= 8 * MERGE_AFTER

    def append(d: str) -> None:
        id_col, cols = keys[d]
        new = dims[d].select(id_col, *cols)
        if known:
            top = known[d].agg(F.max(id_col)).first()[0] or 0
            new = new.where(F.col(id_col) > top)
            if merge:
                new = known[d].unionByName(new)
        new.write.parquet(f"{path}/keys/{name}/{d}")

    together({d: lambda d=d: append(d) for d in keys})
    write_text(spark, f"{path}/{name}/{KEYS}", " ".join(([] if merge else batches) + [name]))


# --------------------------------------------------------------------- weeks


def weeks_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The weeks of a build: some 52 rows a year for each fact."""
    return spark.read.schema(WEEK_SCHEMA).parquet(f"{path.rstrip('/')}/{name}/{WEEKS}")


def read_weeks(spark: SparkSession, path: str, name: str) -> list[Row]:
    return weeks_table(spark, path, name).collect()


def write_weeks(spark: SparkSession, path: str, name: str, weeks: list[tuple]) -> None:
    spark.createDataFrame(weeks, WEEK_SCHEMA).coalesce(1).write.parquet(f"{path}/{name}/{WEEKS}")


def blocks(spark: SparkSession, path: str, name: str) -> int:
    """Builds that hold weeks of this one."""
    return len({w.build for w in read_weeks(spark, path, name)})


# ----------------------------------------------------------------- retention


def finish(spark: SparkSession, path: str, name: str, keep: int = KEEP,
           min_age: float = 0.0) -> None:
    """Mark a build as whole, point to it and remove what is out of date."""
    write_text(spark, f"{path}/{name}/{COMPLETE}", name)
    write_text(spark, f"{path}/{POINTER}", name)
    expire(spark, path, keep, min_age)


def expire(spark: SparkSession, path: str, keep: int = KEEP, min_age: float = 0.0) -> list[str]:
    """Remove builds beyond the newest ``keep`` that were replaced ``min_age``
    seconds ago or earlier, unless one that stays holds weeks or keys of them;
    and builds begun a week ago and never completed.  Returns their names."""
    if keep < 1:
        raise ValueError("the current build is always kept")
    path, now = path.rstrip("/"), time.time()
    whole = complete(spark, path)
    replaced = [now] + [t for _, t in whole[:-1]]     # when the next newer one came
    stay = {n for i, (n, _) in enumerate(whole) if i < keep or now - replaced[i] < min_age}
    stay |= {current(spark, path)} - {None}
    used = {w.build for n in stay for w in read_weeks(spark, path, n)}
    done = {n for n, _ in whole}
    old = sorted(n for n, t in _children(spark, path) if n.startswith("build-")
                 and n not in stay | used and (n in done or now - t > ABANDONED))
    for n in old:
        delete_path(spark, f"{path}/{n}")
    left = {n for n, _ in _children(spark, path) if n.startswith("build-")}
    batches = left | {b for n in left for b in _batches(spark, path, n)}
    for n, _ in _children(spark, f"{path}/keys"):
        if n not in batches:
            delete_path(spark, f"{path}/keys/{n}")
    return old

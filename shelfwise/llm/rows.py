"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

# The white space of the contracts, 0x20 and 0x09..0x0D.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"


def without_spaces(text: Column) -> Column:
    """``text`` without any white space of the contracts; null counts as empty.
    Plain ``replace`` calls work on bytes, unlike a regular expression."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null: 0.  Every space
    becomes the plain one, and a run begins where a character that is not a
    space follows the start or a space."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(t, " "), lambda w: w != F.lit(""))).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it
    (column names clash without regard to case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def scans_alike(df: DataFrame) -> bool:
    """True if every scan of ``df`` has the same rows, each physical row once:
    one file relation under nothing but fixed projections and filters.  A
    union, join, explode, limit or sample may repeat or change rows."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("SubqueryAlias", "Project", "Filter"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation"):
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = relation.location().rootPaths()     # as named by the reader, not the files
    paths = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    return not any(y.startswith(x) for x, y in zip(paths, paths[1:]))


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a struct column that names each physical row.

    For a DataFrame read from Parquet files that is (file, place in the file),
    the same in every scan whatever the splits; any other input is staged
    first, so that its rows have such a place.  A staged copy is a new one in
    each call: keys to be compared must come from one call."""

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.struct(F.col("_metadata.file_path").alias("f"),
                                              F.col("_metadata.row_index").alias("i")))

    if scans_alike(df):
        try:
            return keyed(df)
        except AnalysisException:       # a format without places in the file
            pass
    return keyed(stage(df, "rows"))


ROW_KEY = T.StructType([T.StructField("f", T.StringType()), T.StructField("i", T.LongType())])

"""Reading the weekly feeds and alias tables from CSV; writing cleaned feeds.

Feeds are read with an explicit all-string schema (no inference pass over the
files), then the tokens a CSV export uses for "missing" are turned into NULL,
and numbers are parsed tolerantly (NULL, not an error, on bad text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import try_double, try_long

# The column names of the two feeds.
INTERNAL_COLUMNS = ("Reported_SKU", "Reported_Brand", "Reported_Category", "Reported_Retailer",
                    "Reported_Variant", "Volume", "Unit_Price", "Total_Sales", "Week_Start")
COMPETITOR_COLUMNS = ("Reported_Category", "Reported_Retailer", "Competitor_Volume",
                      "Competitor_Sales", "Week_Start")
# Field texts read as missing (pandas' default NA list).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


# Padding is part of a reported text: neither reader nor writer may trim it.
CSV_OPTIONS = {"header": True, "enforceSchema": False, "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False, "quote": '"', "escape": '"'}


def string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def without_na(df: DataFrame, columns) -> DataFrame:
    """The columns with every missing-value token as NULL."""
    return df.select(*[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) for c in columns])


def typed(df: DataFrame, kind: str) -> DataFrame:
    """Numbers of an all-string feed; NULL where a text is no number or does
    not fit.  ``Total_Sales`` stays text (it is parsed during cleaning)."""
    if kind == "internal":
        return df.withColumns({"Volume": try_double("Volume"),
                               "Unit_Price": try_double("Unit_Price")})
    return df.withColumns({"Competitor_Volume": try_long("Competitor_Volume"),
                           "Competitor_Sales": try_double("Competitor_Sales")})


KINDS = {"internal": INTERNAL_COLUMNS, "competitor": COMPETITOR_COLUMNS}

# Columns beside those of a feed: how many fields a record had against the
# header (whole, short, surplus), and the text of a record that is not whole.
STATE, RECORD = "record_state", "record_text"
# Fixed value: a text that no field holds.
END_MARK = "\u0001end\u0001"


def quoted_break_files(spark: SparkSession, path) -> list[str]:
    """Files in which a quoted field holds a line break: some line of theirs
    has an odd number of quotes.  One narrow scan; a name for each such file
    reaches the driver, as every file's does when it is listed."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.where(quotes % 2 == 1).select("file").distinct().collect()
    return sorted(r["file"] for r in found)


def read_records(spark: SparkSession, path, kind: str, names=None) -> DataFrame:
    """Every record of a feed: its columns as text, ``record_state`` and, if
    it is not whole, ``record_text``.

    Records are cut by quotes, so a quoted line break stays in its field.  Only
    files that have one are read whole by a task; all others stay splittable.
    A short record's missing fields are NULL.  Columns are found by name: with
    ``enforceSchema`` off Spark checks the header of every file against the
    schema, which is put in the file's order, or in that of ``names``."""
    names = list(names or spark.read.options(**CSV_OPTIONS).csv(path).columns)
    missing = [c for c in KINDS[kind] if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    schema = string_schema([*names, RECORD])
    # a parser that skips columns does not see how many fields a record has
    options = CSV_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD,
                             "columnPruning": False}
    broken, file = quoted_break_files(spark, path), F.col("_metadata.file_path")

    def read(multi_line: bool) -> DataFrame:
        return spark.read.schema(schema).options(**options, multiLine=multi_line).csv(path)

    rows = read(False)
    if broken:      # the files are told apart before any of them is opened
        rows = (rows.where(~file.isin(broken)).select(*names, RECORD)
                .unionByName(read(True).where(file.isin(broken)).select(*names, RECORD)))
    # read again with an end mark as one field more: the mark is in one of the
    # header's columns, or next to them, unless there are surplus fields
    # (no part of a field: Spark reads no file for the text of its records alone)
    nothing = F.substring(F.coalesce(F.col(names[0]), F.lit("")), 1, 0)
    again = F.from_csv(F.concat(RECORD, nothing, F.lit(f",{END_MARK}")),
                       ", ".join(f"c{i} string" for i in range(len(names) + 1)),
                       {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    near = F.array(*[again[f"c{i}"] for i in range(len(names) + 1)])
    state = (F.when(F.col(RECORD).isNull(), "whole")
             .when(F.array_contains(near, END_MARK), "short").otherwise("surplus"))
    return rows.withColumn(STATE, state)


def accepted(records: DataFrame, kind: str) -> DataFrame:
    """The typed feed: whole and short records.  One with surplus fields is
    refused, as its values cannot be told apart."""
    rows = records.where(F.col(STATE) != "surplus")
    return typed(without_na(rows, KINDS[kind]), kind)


def refused(records: DataFrame) -> DataFrame:
    """The texts of the records that are in no feed."""
    return records.where(F.col(STATE) == "surplus").select(RECORD)


def record_counts(records: dict[str, DataFrame]) -> DataFrame:
    """``(feed, record_state, records)`` of feeds by kind."""
    out = None
    for kind, df in records.items():
        part = df.groupBy(STATE).agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(kind).alias("feed"), STATE, "records")
        out = part if out is None else out.unionByName(part)
    return out


def read_internal_csv(spark: SparkSession, path) -> DataFrame:
    """The internal feed: text columns as text, ``Volume`` and ``Unit_Price``
    as DOUBLE, ``Total_Sales`` kept as text (parsed during cleaning)."""
    return accepted(read_records(spark, path, "internal"), "internal")


def read_competitor_csv(spark: SparkSession, path) -> DataFrame:
    return accepted(read_records(spark, path, "competitor"), "competitor")


def read_alias_csv(spark: SparkSession, path: str) -> DataFrame:
    """An alias table ``alias, canonical, rank``; rank decides between several
    contained keys.  Without a rank column the order of the lines is the rank,
    which only one unsplit file has: the path must then hold a single one."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "enforceSchema"}
    df = spark.read.options(**options).csv(path)
    if "rank" in df.columns:
        return df.select("alias", "canonical", F.col("rank").cast("int"))
    if len(df.inputFiles()) > 1:
        raise ValueError(f"{path}: several files have no line order; give a rank column")
    # multiLine keeps the one file in one task, so the ids follow its lines
    df = spark.read.options(**options, multiLine=True).csv(path)
    return df.select("alias", "canonical",
                     (F.monotonically_increasing_id() + 1).cast("int").alias("rank"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A CSV dataset with a header whose padding survives."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "enforceSchema"}
    df.write.mode(mode).options(**options).csv(path)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a cleaned feed as a dataset (parquet, or CSV with a header)."""
    if fmt == "csv":
        write_csv(df, path, mode)
    else:
        df.write.mode(mode).parquet(path)

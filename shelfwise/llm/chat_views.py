"""Chat formatting by perspective rotation.

A dialogue of several speakers becomes one training example for each of them:
that speaker's turns are the assistant's, all others are users with their
names, and the mask covers what the assistant is to learn: the text and the
end mark of its own turns.  System turns are shown as such in every view; the
system is no speaker.

A conversation is rendered in parts of 256 turn numbers; char_start says where
a part begins in the whole view.  With distinct turn numbers no row grows with
a conversation without end.  Null turns all belong to part 0 and repeated turns
to the part of their number, so a part with many of those is one row as large
as they are, collected in one task and copied once for each speaker.  The turns
are shuffled once by conversation; the views are made from the grouped turns.

Defined results: turns are ordered by turn (null first), then speaker and
text, so ties have one order and repeated rows are all rendered; a null text
is empty; a null or empty role is the speaker ``unknown``; rows of a null
conv_id are one conversation; a conversation with system turns alone has no
view; the opening ``<|`` of a mark inside a text is written ``< |``; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYSTEM_ROLES = ("system",)
PART_TURNS = 256
END = "<|end|>"


def _plain(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def head(role: Column, speaker: Column, system_roles: tuple) -> Column:
    """The line before a turn, in the view of ``speaker``."""
    return (F.when(role == speaker, F.lit("<|assistant|>\n"))
            .when(role.isin(*system_roles), F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user "), role, F.lit("|>\n"))))


def rotate(turns: DataFrame, system_roles: tuple = SYSTEM_ROLES,
           part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, char_start, n_turns, text, mask: ``mask`` is an
    array of (start, end) in code points of this part's text."""
    role = _plain(F.col("role"))
    rows = turns.select(
        F.col("conv_id"), F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).alias("part"),
        F.struct(F.col("turn"), F.when(role == "", "unknown").otherwise(role).alias("role"),
                 _plain(F.col("text")).alias("text")).alias("t"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    speakers = (rows.where(~F.col("t.role").isin(*system_roles))
                .select(F.col("conv_id").alias("c"), F.col("t.role").alias("speaker")).distinct())
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    # per turn: head and body (text with its end mark), then running lengths
    views = views.withColumn("s", F.transform("turns", lambda t: F.struct(
        head(t["role"], F.col("speaker"), system_roles).alias("head"),
        F.concat(t["text"], F.lit(END)).alias("body"),
        (t["role"] == F.col("speaker")).alias("own"))))
    views = views.withColumn("ends", F.aggregate(
        "s", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(
            F.element_at(acc, -1) + F.length(x["head"]) + F.length(x["body"]) + 1))))
    spans = F.transform("s", lambda x, i: F.struct(
        (F.get(F.col("ends"), i) + F.length(x["head"])).alias("start"),
        (F.get(F.col("ends"), i + 1) - 1).alias("end"), x["own"].alias("own")))
    views = views.select(
        "conv_id", "speaker", "part", F.size("s").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("s", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))))
        .alias("text"),
        F.transform(F.filter(spans, lambda x: x["own"]),
                    lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        .alias("mask"))
    before = (W.partitionBy("conv_id", "speaker").orderBy("part")
              .rowsBetween(W.unboundedPreceding, -1))
    return views.select(
        "conv_id", "speaker", "part",
        F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long")
        .alias("char_start"), "n_turns", "text", "mask")


def rotate_report(turns: DataFrame) -> DataFrame:
    """The views with their mask as text, ``start:end`` joined by commas."""
    mask = F.concat_ws(",", F.transform("mask", lambda x: F.concat_ws(
        ":", x["start"].cast("string"), x["end"].cast("string"))))
    return rotate(turns).withColumn("mask", mask)

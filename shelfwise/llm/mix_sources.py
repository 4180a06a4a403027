"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 48-bit hash.  A source whose target is T and whose size
is S is taken floor(T / S) times whole, and once more for the documents whose
hash lies below a threshold that fills the rest.  The threshold is found from
histograms: sizes are summed by (source, 12-bit hash bucket), the running sum
names the bucket in which the budget ends, and only that boundary bucket is
summed again at the next 12 bits, four times in all.  No rows are sorted and
none are collected; the histogram of a source has at most 4,096 rows whatever
the source holds.  DataFrame functions only.

Defined results: a null text has size 0; the null source is a source of its
own, ordered last; documents of equal hash (repeated rows) are taken or left
together; a source without words has target 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .rows import free_name, word_count

LEVELS, BITS = 4, 12          # 4 x 12 bits = the whole 48-bit hash
WEIGHTS = (1, 2, 3)           # repeated over the sources in code point order
MAX_REPEATS = 3


def doc_hash(doc_id: Column) -> Column:
    """48 bits of the MD5 of the id's decimal text ('' for null)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the only scan of the texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"),
                       doc_hash(F.col("doc_id")).alias("h"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) by water filling.

    Sources share the total by weight, none above max_repeats times its size.
    They fill up in the order of cap / weight, so with the k first ones full
    the level of the others is (total - their caps) / (weights left), and the
    first k whose level the next source can hold is the answer: what resharing
    the excess until none is above converges to.  One row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order) - 1
    per = per.withColumn("w", F.array(*[F.lit(int(w)) for w in weights])[k % len(weights)]
                         .cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    per = (per.withColumn("total", F.sum("source_size").over(everything))
           .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("left", F.sum("w").over(everything)
                       - F.coalesce(F.sum("w").over(before), F.lit(0)))
           .withColumn("level", (F.col("total") - F.col("caps")) / F.col("left"))
           .withColumn("fits", F.col("level") <= F.col("cap") / F.col("w")))
    # the level of the first source, in filling order, that is not full
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))) \
        .over(everything).getField("level")
    per = per.withColumn("water", level)
    return per.select("source", "source_size",
                      F.when(F.col("water").isNull()
                             | (F.col("cap") / F.col("w") < F.col("water")),
                             F.col("cap").cast("double"))
                      .otherwise(F.col("water") * F.col("w")).alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, repeats, cut): documents whose hash is
    below ``cut`` are taken once more than ``repeats`` times.

    ``edge`` is the hash prefix of the bucket in which the budget ends and
    ``filled`` the words below it; each level sums the edge bucket alone."""
    rest = F.col("target") - F.col("repeats") * F.col("source_size")
    state = (goal.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", rest).withColumn("edge", F.lit(0).cast("long"))
        .withColumn("filled", F.lit(0).cast("long")))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        prefix = F.shiftright(F.col("h"), shift)
        inside = sizes.select("source", "size", prefix.alias("b")).alias("d")
        if level:
            near = state.where("rest > 0").select(F.col("source").alias("s"), "edge")
            inside = inside.join(near, F.col("source").eqNullSafe(F.col("s"))
                                 & (F.shiftright("b", BITS) == F.col("edge"))).drop("s", "edge")
        hist = inside.groupBy("source", "b").agg(F.sum("size").alias("words"))
        running = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        hist = (hist.withColumn("below", F.coalesce(F.sum("words").over(running), F.lit(0)))
                .select(F.col("source").alias("s"), "b", "words", "below"))
        # the last bucket that starts below the budget
        on = F.col("source").eqNullSafe(F.col("s")) & (F.col("filled") + F.col("below")
                                                       < F.col("rest"))
        state = (state.drop("words", "edge").join(hist, on, "left")
                 .groupBy("source", "source_size", "target", "repeats", "rest", "filled")
                 .agg(F.max(F.struct("b", "below", "words")).alias("m"))
                 .select("source", "source_size", "target", "repeats", "rest",
                         F.coalesce(F.col("m.b"), F.lit(0)).alias("edge"),
                         (F.col("filled") + F.coalesce(F.col("m.below"), F.lit(0)))
                         .alias("filled"), F.col("m.words").alias("words")))
        state = stage(state, "mix-level")     # one row per source
    # the documents of the last edge: in, if that ends nearer to the budget
    gain = F.coalesce(F.col("words"), F.lit(0))
    cut = (F.when(F.col("rest") <= 0, 0)
           .when(F.col("rest") - F.col("filled") >= F.col("filled") + gain - F.col("rest"),
                 F.col("edge") + 1)
           .otherwise(F.col("edge")).cast("long"))
    return state.select("source", "source_size", "target", "repeats", cut.alias("cut"))


def _copies(rule: str = "repeats", cut: str = "cut", h: str = "h") -> Column:
    return F.col(rule) + F.when(F.col(h) < F.col(cut), 1).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = stage(sized(docs), "sizes")
    rules = thresholds(sizes, stage(targets(sizes), "mix-targets")).withColumnRenamed("source", "s")
    return (sizes.join(rules, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * _copies()).alias("taken")))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it,
    its columns unchanged.  The rules have one row per source, so the texts
    meet them without a sort."""
    sizes = stage(sized(docs), "sizes")
    rules = thresholds(sizes, stage(targets(sizes), "mix-targets"))
    s, r, c, h, n = (free_name(docs, x) for x in ("s", "repeats", "cut", "h", "copy"))
    rules = rules.select(F.col("source").alias(s), F.col("repeats").alias(r),
                         F.col("cut").alias(c))
    return (docs.withColumn(h, doc_hash(F.col("doc_id")))
            .join(rules, F.col("source").cast("string").eqNullSafe(F.col(s)))
            .withColumn(n, F.explode(F.array_repeat(F.lit(1), _copies(r, c, h).cast("int"))))
            .drop(s, r, c, h, n))

"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per component, 1 where it is positive.  The code
is cut into m segments, and every distinct code is indexed under each segment's
value.  Segment i is searched within radius r_i.  If two codes differ in fewer
bits than the sum of all r_i + 1, some segment differs in r_i bits at most; so
looking up all values within the radii finds every code below that distance.
The radii grow, half of the segments at a time, only for the queries whose k-th
verified neighbour is not yet within the proven distance.  A code that several
segments would find is found by the first of them.

Segments have the largest power-of-two length whose values are not more than
the codes, so a lookup meets few codes whatever the table's size.

A segment's values are looked up in two steps.  Its leading bits name a bucket:
a query is sent to the buckets within the radius, and what is left of the
radius is flipped in the trailing bits only there, against the bucket's codes.
So the values looked up, thousands a query, are neither shuffled nor broadcast;
a bucket of many codes is dealt out to several tasks.  Of each round a query
keeps k + 1 codes, by distance and smallest id: the others have no row among
its k + 1 nearest.

Defined results: a null vector neither asks nor answers; missing components
count as not positive, NaN as positive; ties in distance are ordered by id;
rows of equal code (a third of the table may have one) are one entry of the
index, with its k + 1 smallest ids; a query never finds its own id, but does
find other rows of the same code; repeated ids answer once; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

WORD = 64
QUERY_EVERY = 100
# Index entries of a task, whose table it holds in memory, and of a cell: the
# part of a bucket that one task looks up.
TASK_ENTRIES, BUCKET_ENTRIES = 100_000, 20_000


def sign_words(vector: Column, dims: int) -> list[Column]:
    """The code as 64-bit words."""
    out = []
    for base in range(0, dims, WORD):
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - base) if i - base < 63
                                                         else -1 << 63).cast("long"))
                .otherwise(F.lit(0).cast("long")) for i in range(base, min(dims, base + WORD))]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return out


def segment_bits(codes: int, bits: int) -> int:
    """8, 16 or 32: the longest whose values are not more than the codes."""
    fit = [s for s in (8, 16, 32) if s <= bits and (1 << s) <= max(codes, 256)]
    return max(fit, default=8)


def segment(words: list[str], s: int, i: int) -> Column:
    per = WORD // s
    return F.shiftrightunsigned(F.col(words[i // per]), s * (i % per)).bitwiseAND(
        F.lit((1 << s) - 1).cast("long"))


def lead_bits(s: int) -> int:
    """Bits of a segment's value that name its bucket."""
    return s if s <= 8 else s // 2


def bucket_of(value: Column, s: int) -> Column:
    """Number of the bucket of a value of segment ``seg``."""
    lead = lead_bits(s)
    return F.shiftleft(F.col("seg").cast("long"), lead).bitwiseOR(
        F.shiftrightunsigned(value, s - lead)).cast("int")


def dealt(tasks: int) -> list[Column]:
    """The cell, and the number of its task."""
    return [F.col("cell"), (F.col("cell") % tasks).cast("int").alias("task")]


def place(rest: Column, s: int) -> Column:
    """Cell and trailing bits of a value in one number; with the task's it packs
    into one long join key, unless segments have 32 bits."""
    return F.shiftleft("cell", s - lead_bits(s)).bitwiseOR(rest).cast(
        "int" if s < 32 else "long")


def masks(s: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(s), radius)]


def flips(s: int, radius: int) -> str:
    """SQL array of the masks of ``s`` bits with at most ``radius`` ones."""
    return f"array({', '.join(f'{x}L' for n in range(min(s, radius) + 1) for x in masks(s, n))})"


def searched(open_codes: DataFrame, words: list[str], asking: list[str], s: int,
             radii: list[int], buckets: DataFrame, tasks: int) -> DataFrame:
    """(asking.., seg, task, place): the places of every value within the radii
    of the segments of each code.  Leading bits are flipped before the shuffle,
    trailing ones after it."""
    low = s - lead_bits(s)
    most, least = max(radii), min(radii)
    asks = [F.struct(F.lit(i).alias("seg"), segment(words, s, i).alias("at"),
                     F.lit(radii[i]).alias("radius")) for i in range(len(radii))]
    leads = F.when(F.col("radius") == most, F.expr(flips(s - low, most))).otherwise(
        F.expr(flips(s - low, least)))
    sent = (open_codes.select(*[F.col(w).alias(q) for w, q in zip(words, asking)],
                              F.inline(F.array(*asks)))
            .withColumn("flip", F.explode(leads))
            .withColumn("bucket", bucket_of(F.col("at").bitwiseXOR(F.shiftleft("flip", low)), s))
            .join(F.broadcast(buckets), "bucket")
            .withColumn("cell", F.explode(F.sequence("start", F.col("start") + F.col("parts") - 1)))
            .select(*asking, "seg", *dealt(tasks),
                    F.col("at").bitwiseAND(F.lit((1 << low) - 1)).alias("rest"),
                    F.least(F.col("radius") - F.bit_count("flip"), F.lit(low)).alias("left"))
            .repartitionById(tasks, "task"))
    trails = F.expr(f"array({', '.join(flips(low, n) for n in range(min(low, most) + 1))})")
    return (sent.withColumn("flip", F.explode(F.get(trails, F.col("left"))))
            .select(*asking, "seg", "task",
                    place(F.col("rest").bitwiseXOR(F.col("flip")), s).alias("place")))


def coded(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, w0, w1, ..) of every row with a vector and an id, each id once."""
    v = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    words = sign_words(F.col(vector_col), dims)
    return v.select(F.col(id_col).cast("long").alias("id"),
                    *[w.alias(f"w{i}") for i, w in enumerate(words)]).distinct()


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest other rows of each
    query by Hamming distance."""
    size = F.max(F.size(vector_col))
    dims = max(1, vectors.agg(size).first()[0] or 1)
    rows = stage(coded(vectors, id_col, vector_col, dims), "codes")
    words = [c for c in rows.columns if c != "id"]
    # of each code the k + 1 smallest ids: row_number's limit applies within tasks first
    few = rows.withColumn("n", F.row_number().over(W.partitionBy(*words).orderBy("id")))
    few = few.where(F.col("n") <= k + 1)
    index = stage(few.groupBy(*words).agg(F.sort_array(F.collect_list("id")).alias("ids")),
                  "code-index")
    asked = stage(coded(queries, id_col, vector_col, dims), "queries")
    open_codes = stage(asked.select(*words).distinct(), "query-codes")
    n_codes = index.count()
    s = segment_bits(n_codes, dims)
    m = len(words) * WORD // s
    low = s - lead_bits(s)
    pairs = [F.struct(F.lit(i).alias("seg"), segment(words, s, i).alias("value"))
             for i in range(m)]
    entries = index.select(*words, F.size("ids").alias("copies"),
                           F.get("ids", F.lit(0)).alias("head"), F.inline(F.array(*pairs)))
    entries = entries.withColumn("bucket", bucket_of(F.col("value"), s))
    # a bucket is one cell, or several if it has many codes; the tasks take cells in turn
    buckets = entries.groupBy("bucket").agg(
        F.ceil(F.count("*") / BUCKET_ENTRIES).cast("long").alias("parts"))
    buckets = stage(buckets.withColumn("start", F.sum("parts").over(
        W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select(
        "bucket", F.coalesce("start", F.lit(0)).cast("long").alias("start"), "parts"), "buckets")
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism,
                -(-n_codes * m // TASK_ENTRIES))
    entries = (entries.join(F.broadcast(buckets), "bucket")
               .withColumn("cell", F.col("start") + F.pmod(F.xxhash64(*words), F.col("parts")))
               .select(*words, "copies", "head", *dealt(tasks),
                       F.col("value").bitwiseAND(F.lit((1 << low) - 1)).alias("rest"))
               .withColumn("place", place(F.col("rest"), s)).drop("cell", "rest")
               .repartitionById(tasks, "task"))
    asking = [f"q{i}" for i in range(len(words))]
    other = [F.col(w).bitwiseXOR(F.col(q)) for w, q in zip(words, asking)]
    apart = reduce(lambda a, b: a + b, [F.bit_count(x) for x in other])
    mask, per = F.lit((1 << s) - 1).cast("long"), WORD // s
    nearest = W.partitionBy(*asking).orderBy("distance", "head")
    found = []
    reached = m                        # the sum of all r_i + 1
    while True:
        proven = reached - 1
        last = proven >= len(words) * WORD
        whole, more = divmod(reached, m)
        radii = [whole if i < more else whole - 1 for i in range(m)]
        first = reduce(lambda a, b: a & b, [
            (F.col("seg") <= i) | (F.bit_count(F.shiftrightunsigned(
                other[i // per], s * (i % per)).bitwiseAND(mask)) > radii[i])
            for i in range(m)])
        probes = searched(open_codes, words, asking, s, radii, buckets, tasks)
        near = (entries.hint("shuffle_hash").join(probes, ["task", "place"])
                .where((apart <= proven) & first)
                .select(*asking, *words, apart.alias("distance"), "copies", "head")
                .withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
                .withColumn("seen", F.sum("copies").over(W.partitionBy(*asking))))
        near = stage(near.drop("n", "head"), "near-codes")
        if last:
            found.append(near)
            break
        enough = near.where(F.col("seen") >= k + 1)
        found.append(enough)
        done = enough.select(*[F.col(q).alias(w) for q, w in zip(asking, words)]).distinct()
        open_codes = stage(open_codes.join(done, words, "left_anti"), "query-codes")
        if open_codes.isEmpty():
            break
        reached += max(1, m // 2)
    hits = reduce(DataFrame.union, found)
    # only the nearest codes of a query can hold its k nearest rows
    hits = hits.withColumn("before", F.coalesce(F.sum("copies").over(
        W.partitionBy(*asking).orderBy("distance").rangeBetween(W.unboundedPreceding, -1)),
        F.lit(0))).where(F.col("before") <= k)
    answers = hits.join(index, words).select(*asking, "distance",
                                             F.explode("ids").alias("neighbor_id"))
    best = W.partitionBy(*asking).orderBy("distance", "neighbor_id")
    answers = answers.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = asked.select(F.col("id").alias("query_id"),
                         *[F.col(w).alias(q) for w, q in zip(words, asking)])
    out = named.join(answers, asking).where("neighbor_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return (out.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "neighbor_id", F.col("distance").cast("int")
                    .alias("distance")))

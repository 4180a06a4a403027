"""Entity resolution: map messy spellings to canonical values.

Tiers, cheapest first, each seeing only what the previous one left:

1. exact      stripped lower-case text equals an alias key
2. substring  some alias key is contained in the text; the key with the
              lowest rank (position in the alias table) wins
3. fuzzy      best ``difflib`` ratio of the raw text against the canonical
              values (>= cutoff), else of the lower-case text against the
              alias keys
4. Unknown    nothing matched, or the value is NULL

Work is proportional to *distinct* spellings, not rows: the feed is reduced to
its distinct values (partial aggregation map-side, so a hot spelling costs one
row per partition), resolved, and joined back.  Several entity columns are
resolved together: every table carries an entity id ``e`` that is part of
every join key, so brand, category, retailer and variant cost one set of
jobs, not four.

An alias table has columns ``alias STRING, canonical STRING, rank INT``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import SCORE_SCHEMA, score_group
from ..functions.text import norm_key
from ..session import stage
from .keys import dense_key

# The label of a value no tier resolves, and the letters that
# replace one character in the rule-generated alias spellings.
UNKNOWN = "Unknown"
TYPO_LETTERS = "aesxz"

# A group of the fuzzy tier is one bucket of values against one chunk of the
# candidate pool: about 200,000 comparisons, whatever the data.
FUZZY_POOL_CHUNK = 1000
FUZZY_VALUES_PER_BUCKET = 200
# Its rounds begin at these similarities, the last one at the cutoff.
FUZZY_STEPS = (0.75, 0.0)
ROUNDS_FROM_BUCKETS = 4
# The alias index is broadcast to the substring join up to this many bytes of
# keys and targets; a larger one takes a sort-merge join.
INDEX_BROADCAST_BYTES = 32 << 20


def alias_index(alias: DataFrame) -> DataFrame:
    """Lower-case the keys and merge duplicates like an ordered dict would:
    the target of the *last* entry wins, the position of the *first* stays.
    Keeps an entity column ``e`` when there is one."""
    if "e" not in alias.columns:
        alias = alias.withColumn("e", F.lit(0))
    return (alias.select("e", F.lower("alias").alias("alias"), "canonical", "rank")
            .groupBy("e", "alias")
            .agg(F.max_by("canonical", "rank").alias("canonical"),
                 F.min("rank").alias("rank")))


def match_exact(values: DataFrame, index: DataFrame) -> DataFrame:
    """``values(e, raw)`` -> ``(e, raw, canonical)`` for exact key hits."""
    return (values.withColumn("alias", norm_key("raw"))
            .join(index.select("e", "alias", "canonical"), ["e", "alias"])
            .select("e", "raw", "canonical"))


def index_profile(index: DataFrame) -> tuple[list[int], int]:
    """(lengths of the keys, bytes of keys and targets): one small row, by
    which the substring join decides what to generate and what to broadcast."""
    r = index.agg(F.sort_array(F.collect_set(F.length("alias"))).alias("lengths"),
                  F.sum(F.octet_length("alias") + F.octet_length("canonical") + 24).alias("b")
                  ).first()
    return [n for n in r["lengths"] if n], int(r["b"] or 0)


def match_substring(values: DataFrame, index: DataFrame, lengths: list[int] | None = None,
                    index_bytes: int | None = None) -> DataFrame:
    """``values(e, raw)`` -> ``(e, raw, canonical)`` of the lowest-ranked
    contained key.

    Every substring of the whole stripped lower-case text whose length some
    key has is generated and equi-joined to the keys: the containment (theta)
    join becomes a hash join whose work is ``distinct values x text length x
    key lengths``, never values x keys.  The index is the build side if its
    measured bytes allow; the generated side, whose size no estimate knows,
    never is.
    """
    if lengths is None or index_bytes is None:
        lengths, index_bytes = index_profile(index)
    if not lengths:
        return values.select("e", "raw", F.lit(None).cast("string").alias("canonical")).limit(0)
    s = values.withColumn("s", norm_key("raw")).filter(F.length("s") >= lengths[0])
    sized = s.select("e", "raw", "s", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n"))
    sized = sized.filter(F.length("s") >= F.col("n"))
    # no distinct here: the substrings stream straight into the join with the
    # key index and the partial aggregate, so only matches shuffle; a repeated
    # substring only repeats a match, which min_by ignores
    subs = sized.select("e", "raw", F.explode(F.expr(
        "transform(sequence(1, length(s) - n + 1), i -> substring(s, i, n))")).alias("alias"))
    build = (F.broadcast(index) if index_bytes <= INDEX_BROADCAST_BYTES
             else index.hint("merge"))
    return (subs.join(build, ["e", "alias"])
            .groupBy("e", "raw")
            .agg(F.min_by("canonical", "rank").alias("canonical")))


def _fuzzy_pass(values: DataFrame, pool: DataFrame, cutoffs: dict, kind: str,
                materialize: bool = False) -> DataFrame:
    """One similarity pass: ``values(e, raw)`` against ``pool(e, text,
    canonical)``; returns ``(e, raw, canonical)`` for values with a match.

    In rounds of falling similarity: a value whose best match reaches the
    round's limit is done, as all candidates that near were compared; only the
    others meet more distant candidates, down to the cutoff.

    The pool is numbered in order of length and cut into chunks.  The ratio of
    two texts is at most 2 * shorter / (shorter + longer), so a value meets
    only the chunks whose lengths can reach its limit: nothing that could
    match is skipped."""
    n_values = values.count()
    if n_values == 0:
        return values.select("e", "raw", F.lit(None).cast("string").alias("canonical"))
    buckets = -(-n_values // FUZZY_VALUES_PER_BUCKET)
    pool = dense_key(pool.withColumn("len", F.length("text")).distinct(),
                     ["e", "len", "text"], "at")
    pool = pool.withColumn("chunk", F.floor(F.col("at") / FUZZY_POOL_CHUNK).cast("int"))
    cut = {int(k): float(v) for k, v in cutoffs.items()}
    # spaces count in the raw text and not in the stripped one
    size = F.length("raw") if kind == "canonical" else F.length(norm_key("raw"))
    left = values.select("e", "raw").withColumns({
        "bucket": F.pmod(F.xxhash64("raw"), F.lit(buckets)).cast("int"), "len": size})
    hits, done = [], None
    # few values take one round: the same result with fewer jobs
    for step in FUZZY_STEPS if buckets > ROUNDS_FROM_BUCKETS else FUZZY_STEPS[-1:]:
        limits = {e: max(c, step) for e, c in cut.items()}
        if limits == done:      # nothing more distant than the round before
            continue
        done = limits
        hit = _fuzzy_round(left, pool, limits, kind)
        if materialize:         # read by the next round's anti-join and by the result
            hit = stage(hit, f"fuzzy-{kind}")
        hits.append(hit)
        left = left.join(hit.select("e", "raw"), ["e", "raw"], "left_anti")
    return reduce(DataFrame.unionByName, hits)


def _fuzzy_round(values: DataFrame, pool: DataFrame, limits: dict, kind: str) -> DataFrame:
    """The best match of each value, of similarity ``limits[e]`` or more."""
    chunks = pool.groupBy("e", "chunk").agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("e"))
    # products on both sides: a limit of 0 lets every length pass
    vals = (values.withColumn("cut", limit).join(chunks, "e")
            .where((F.col("lo") * F.col("cut") <= F.col("len") * (2 - F.col("cut")))
                   & (F.col("hi") * (2 - F.col("cut")) >= F.col("len") * F.col("cut")))
            .select("e", "raw", "bucket", "chunk"))
    met = vals.select("e", "chunk", "bucket").distinct()
    # names of its own: both sides of the cogroup come from ``vals``
    near = pool.join(met, ["e", "chunk"]).select(
        "text", "canonical", F.col("e").alias("pe"), F.col("bucket").alias("pbucket"),
        F.col("chunk").alias("pchunk"))

    def scorer(vpdf, ppdf):
        e = int(vpdf["e"].iloc[0]) if len(vpdf) else 0
        out = score_group(vpdf, ppdf, limits.get(e, 1.0), kind)
        out["e"] = e
        return out

    scored = (vals.groupBy("e", "bucket", "chunk")
              .cogroup(near.groupBy("pe", "pbucket", "pchunk"))
              .applyInPandas(scorer, SCORE_SCHEMA + ", e int"))
    # best over the chunks: highest score, a tie to the greater candidate text
    best = scored.groupBy("e", "raw").agg(F.max(F.struct("score", "match", "canonical")).alias("b"))
    return best.select("e", "raw", F.col("b.canonical").alias("canonical"))


def match_fuzzy(values: DataFrame, index: DataFrame, cutoffs: dict,
                materialize: bool = False) -> DataFrame:
    """``values(e, raw)`` -> ``(e, raw, canonical)`` by best similarity.

    Two passes, as the tiers are defined: the raw text against the canonical
    values first, then, for the values still without a match, the lower-case
    text against the alias keys (the large pool).  In each pass the pool is cut
    into chunks of at most ``FUZZY_POOL_CHUNK`` entries and the values into
    hash buckets of about ``FUZZY_VALUES_PER_BUCKET``; each (entity, bucket,
    chunk) is one bounded ``applyInPandas`` cogroup.  Every value meets every
    candidate of its pass that its length allows, so the result is exact, and
    no pool goes through the driver.
    """
    if values.isEmpty():
        return values.select("e", "raw", F.lit(None).cast("string").alias("canonical"))
    canon_pool = index.select("e", F.col("canonical").alias("text"), "canonical").distinct()
    hit = _fuzzy_pass(values, canon_pool, cutoffs, "canonical", materialize)
    if materialize:
        hit = stage(hit, "fuzzy-canonical")
    rest = values.join(hit.select("e", "raw"), ["e", "raw"], "left_anti")
    if materialize:
        rest = stage(rest, "fuzzy-rest")
    key_pool = index.select("e", F.col("alias").alias("text"), "canonical")
    return hit.unionByName(_fuzzy_pass(rest, key_pool, cutoffs, "key",
                                            materialize))


def resolve_values(values: DataFrame, alias: DataFrame, cutoffs,
                   tiers=("exact", "substring", "fuzzy"), materialize: bool = False) -> DataFrame:
    """Resolve a table of distinct raw spellings ``(e, raw)`` (or ``(raw)``).

    ``cutoffs``: a float, or ``{e: float}`` per entity.  Returns ``(e, raw,
    canonical, match_tier)``, one row per input value; ``canonical`` is
    ``Unknown`` and ``match_tier`` ``none`` when no tier hit.
    """
    if "e" not in values.columns:
        values = values.withColumn("e", F.lit(0))
    if not isinstance(cutoffs, dict):
        cutoffs = {0: cutoffs}
    index = alias_index(alias)
    if materialize:
        # read by every tier (and both fuzzy pools): written once
        index = stage(index, "alias-index")
    values = values.select("e", "raw").filter(F.col("raw").isNotNull())
    hits = []
    left = values
    for tier in tiers:
        if tier == "exact":
            hit = match_exact(left, index)
        elif tier == "substring":
            hit = match_substring(left, index)
        elif tier == "fuzzy":
            if materialize:
                # what the cheap tiers left: small; written once so the
                # Python tier and its size check read it instead of
                # re-running the joins above
                left = stage(left, "unresolved")
            hit = match_fuzzy(left, index, cutoffs, materialize)
        else:
            raise ValueError(f"unknown tier {tier!r}")
        hit = hit.filter(F.col("canonical").isNotNull()).withColumn("match_tier", F.lit(tier))
        if materialize:     # read by the next tier's anti-join and by the result
            hit = stage(hit, f"hits-{tier}")
        hits.append(hit)
        left = left.join(hit.select("e", "raw"), ["e", "raw"], "left_anti")
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    return (values.join(found, ["e", "raw"], "left")
            .select("e", "raw", F.coalesce("canonical", F.lit(UNKNOWN)).alias("canonical"),
                    F.coalesce("match_tier", F.lit("none")).alias("match_tier")))


def resolve_spellings(frames, aliases: dict, cutoffs: dict,
                      materialize: bool = True) -> DataFrame:
    """Resolve the spellings of many columns of many frames in one pass.

    ``frames``: ``[(df, {column: entity}), ...]``; ``aliases`` and ``cutoffs``
    are keyed by entity name.  The distinct ``(entity, spelling)`` pairs of
    every listed column are gathered (partial aggregation before the shuffle),
    resolved together and returned as ``(entity, raw, canonical,
    match_tier)``.  Columns of the same entity share the work, e.g. the
    category spellings of both feeds.
    """
    names = sorted(aliases)
    eid = {n: i for i, n in enumerate(names)}
    spellings = None
    for df, cols in frames:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(eid[ent]).alias("e"), F.col(c).cast("string").alias("raw"))
            for c, ent in cols.items()]))
        part = df.select(pairs.alias("x")).select("x.e", "x.raw")
        spellings = part if spellings is None else spellings.unionByName(part)
    spellings = spellings.distinct()
    alias = None
    for n in names:
        a = aliases[n].select("alias", "canonical", "rank").withColumn("e", F.lit(eid[n]))
        alias = a if alias is None else alias.unionByName(a)
    if materialize:
        spellings = stage(spellings, "spellings")
    res = resolve_values(spellings, alias, {eid[n]: cutoffs[n] for n in names},
                         materialize=materialize)
    ent = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("e") + 1)
    res = res.select(ent.alias("entity"), "raw", "canonical", "match_tier")
    return stage(res, "resolved") if materialize else res


def attach(df: DataFrame, resolved: DataFrame, cols: dict, tier_cols: bool = False) -> DataFrame:
    """Join resolved spellings back: ``cols`` maps a raw column to
    ``(entity, output column)``.  Unresolved or NULL spellings give Unknown.

    No join strategy is forced: the resolved table is a written one, so AQE
    knows its bytes, broadcasts it if they are few and else splits the
    partition of a hot spelling.
    """
    out = df
    for i, (col, (entity, target)) in enumerate(cols.items()):
        r = resolved.filter(F.col("entity") == entity).select(
            F.col("raw").alias(f"__raw{i}"), F.col("canonical").alias(f"__c{i}"),
            F.col("match_tier").alias(f"__t{i}"))
        out = out.join(r, F.col(col) == F.col(f"__raw{i}"), "left")
        new = {target: F.coalesce(F.col(f"__c{i}"), F.lit(UNKNOWN))}
        if tier_cols:
            new[f"{target}_tier"] = F.coalesce(F.col(f"__t{i}"), F.lit("none"))
        out = out.withColumns(new).drop(f"__raw{i}", f"__c{i}", f"__t{i}")
    return out


def resolve_columns(df: DataFrame, specs, materialize: bool = True,
                    tier_cols: bool = False) -> DataFrame:
    """Resolve several entity columns of one frame.

    ``specs``: ``[(column, alias_df, cutoff, out_column), ...]``; each column
    is its own entity.
    """
    aliases = {c: a for c, a, _, _ in specs}
    cutoffs = {c: cut for c, _, cut, _ in specs}
    res = resolve_spellings([(df, {c: c for c, _, _, _ in specs})], aliases, cutoffs, materialize)
    return attach(df, res, {c: (c, out) for c, _, _, out in specs}, tier_cols)


def resolve_entity(df: DataFrame, col: str, alias: DataFrame, cutoff: float = 0.5,
                   out: str | None = None, tier_col: bool = False,
                   materialize: bool = True) -> DataFrame:
    """Add ``out`` (default: ``col``) holding the canonical value of ``col``."""
    return resolve_columns(df, [(col, alias, cutoff, out or col)], materialize, tier_col)


def typo_aliases(canonicals: DataFrame, letters: str = TYPO_LETTERS) -> DataFrame:
    """Alias table generated by rule from a column ``canonical``.

    Keys: each canonical itself, then every spelling with one character
    replaced by one of ``letters`` (the dominant corruption in sales feeds).
    Rank orders by (canonical, position, letter), the canonical first.  The
    table has canonicals x length x letters rows: dictionary sized.
    """
    c = canonicals.select("canonical").filter(F.col("canonical").isNotNull()).distinct()
    own = c.select("canonical", F.lit(0).alias("pos"), F.lit("").alias("letter"),
                   F.col("canonical").alias("alias"))
    gen = (c.select("canonical",
                    F.explode(F.sequence(F.lit(1), F.length("canonical"))).alias("pos"))
           .select("canonical", "pos",
                   F.explode(F.array(*[F.lit(x) for x in letters])).alias("letter"))
           .withColumn("alias", F.overlay("canonical", F.col("letter"), F.col("pos"), F.lit(1))))
    ranked = dense_key(own.unionByName(gen), ["canonical", "pos", "letter"], "rank")
    return ranked.select(F.lower("alias").alias("alias"), "canonical",
                         F.col("rank").cast("int").alias("rank"))

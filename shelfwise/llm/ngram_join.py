"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

A document is the set of its distinct k-word shingles (hashed to 64 bits).
All sets put their shingles in one global order, the rare ones first, taken
from a fixed-size table of shingle counts over all documents.  Two sets that
reach the threshold share elements among the first few of both:

* light (small) sets enumerate all 2-subsets of their prefix: two of them that
  link share a subset, and a subset is far rarer than an element;
* heavy (large) sets have too many subsets; they scan inverted lists: every
  set large enough to link with one puts its prefix in the lists.

The boundary between them is the size with the least estimated cost, from the
histogram of sizes.  A hit must still allow the needed overlap, given both
positions in the prefixes; a parity bitmap bounds the symmetric difference
from below; and what is left is verified on the whole sets.

Equal sets are one class.  Within a list, every class is first compared with
one centre; what links is one component, and only pairs of different
components are enumerated after that, so a group of thousands of near copies
costs its size, not its square, and no link between components is lost.

Defined results: A-Z are lower-cased, words are runs of other than 0x20 and
0x09..0x0D; a document with fewer than k words is one shingle, its whole word
sequence; a null, empty or blank text has the empty set and links with
nothing; repeated rows are one class; an empty table gives an empty result; a
null doc_id takes part but never names a component unless all are null;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .rows import free_name, with_row_key
from .textbytes import lower_ascii, mix64, span_hash, text_buffer, word_spans

THREE = np.uint64(3)
SKETCH_BITS = 20          # shingle counts are kept for 2**20 hash slots
SLICE = 4096              # slots in one row of the sketch
BITMAP_BITS = 1024
SCAN_COST = 4.0           # cost of a place in an inverted list, in subset keys
LEVELS_AN_OCTAVE = 8
PART_BYTES = 1 << 20


# ------------------------------------------------------------------ shingles


def parts(batch: pa.RecordBatch, limit: int = PART_BYTES):
    """The batch in runs of rows of about ``limit`` bytes."""
    step = max(1, int(batch.num_rows * limit / max(1, batch.get_total_buffer_size())))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle, repeats included, in order of
    the documents; a document with 1..k-1 words has one of all its words."""
    start, end, doc = word_spans(data, offsets)
    h = span_hash(lower_ascii(data), start, end)
    n = len(h)
    if n == 0:
        return h, doc
    words = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    out, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        acc = h[:n - k + 1].copy()
        for j in range(1, k):
            acc = mix64(acc * THREE + h[j:n - k + 1 + j])
        inside = doc[:n - k + 1] == doc[k - 1:]
        out, docs = acc[inside], doc[:n - k + 1][inside]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        one = np.empty(len(short), np.uint64)
        for i, d in enumerate(short.tolist()):
            acc = h[first[d]:first[d] + 1]
            for j in range(1, int(words[d])):
                acc = mix64(acc * THREE + h[first[d] + j:first[d] + j + 1])
            one[i] = mix64(acc + np.uint64(int(words[d])))[0]
        out, docs = np.concatenate([out, one]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        out, docs = out[order], docs[order]
    return out, docs


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every document."""
    h, doc = shingles(data, offsets, k)
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


# ------------------------------------------------- global order and the boundary


def sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels per slot, set sizes, documents per size) over all documents.

    Tasks count shingles by hash slot and send their table in slices, which
    are added up per slice; only the finished table, of fixed size, reaches
    the driver.  The level of a slot is the logarithm of its count, 0 up to
    four times the mean: an order that puts what is frequent last."""

    def count(batches):
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        sizes: dict[int, int] = {}
        for b in batches:
            for s in parts(b):
                h, doc = shingles(*text_buffer(s.column(0)), k)
                table += np.bincount((h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64),
                                     minlength=len(table))
                for n, m in zip(*np.unique(size_class(np.bincount(doc, minlength=s.num_rows)),
                                           return_counts=True)):
                    sizes[int(n)] = sizes.get(int(n), 0) + int(m)
        if sizes:
            rows = [table[a:a + SLICE].astype("<i8").tobytes()
                    for a in range(0, len(table), SLICE)]
            hist = np.array(sorted(sizes.items()), "<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*range(len(rows)), -1], pa.int32()),
                 pa.array([*rows, hist], pa.binary())], ["at", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        sizes: dict[int, int] = {}
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, "<i8")
                if at < 0:
                    for n, m in x.reshape(-1, 2).tolist():
                        sizes[n] = sizes.get(n, 0) + m
                elif at in total:
                    total[at] = total[at] + x
                else:
                    total[at] = x
        if sizes:
            total[-1] = np.array(sorted(sizes.items()), "<i8").ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())],
            ["at", "counts"])

    kind = "at int, counts binary"
    got = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, kind)
           .repartition("at").mapInArrow(add, kind).toArrow())
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    hist = np.zeros((0, 2), np.int64)
    for at, raw in zip(got["at"].to_pylist(), got["counts"].to_pylist()):
        x = np.frombuffer(raw, "<i8")
        if at < 0:
            hist = x.reshape(-1, 2)
        else:
            table[at * SLICE:(at + 1) * SLICE] = x
    start = 4 * max(1.0, table.mean())
    level = np.ceil(LEVELS_AN_OCTAVE * np.log2(np.maximum(table, 1) / start))
    return np.clip(level, 0, 255).astype(np.uint8), hist[:, 0], hist[:, 1]


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes up to 256 as they are, larger ones rounded up to 1/32 of an octave
    (the histogram stays small whatever the sizes)."""
    n = np.asarray(n, np.int64)
    big = np.ceil(np.exp2(np.ceil(np.log2(np.maximum(n, 1)) * 32) / 32)).astype(np.int64)
    return np.where(n <= 256, n, big)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements a set of size n shares with any set that it links with."""
    return -(-percent * np.asarray(n, np.int64) // 100)


def boundary(sizes: np.ndarray, counts: np.ndarray, percent: int) -> int:
    """The largest size that enumerates subsets, by least total cost: subsets
    of every set up to it, places in inverted lists for every set that can
    link with a larger one."""
    sizes = np.asarray(sizes, np.float64)
    one = sizes - least_overlap(sizes, percent) + 1
    two = one + 1
    pairs = counts * two * (two - 1) / 2
    lists = counts * one * SCAN_COST
    best, at = None, 0
    for x in [0, *np.unique(size_class(np.arange(1, 4097))).tolist()]:
        cost = pairs[sizes <= x].sum() + lists[100 * sizes > percent * x].sum()
        if best is None or cost < best:
            best, at = cost, x
    return at


# ---------------------------------------------------------------- sets and keys


def ordered_keys(s: np.ndarray, level: np.ndarray, percent: int, edge: int):
    """(keys, positions) of one sorted set: prefix elements for the inverted
    lists if it can link with a heavy set, 2-subsets if it is light."""
    n = len(s)
    low = (s & np.uint64(len(level) - 1)).astype(np.int64)
    order = np.lexsort((s, level[low]))
    p = n - int(least_overlap(n, percent)) + 1
    keys, place = [s[:0]], [np.zeros(0, np.int64)]   # one element links with its equal only
    if 100 * n > percent * edge:
        keys.append(s[order[:p]])
        place.append(np.arange(p))
    if n <= edge and n > 1:
        q = s[order[:p + 1]]
        i, j = np.triu_indices(len(q), 1)
        keys.append(mix64(q[i] * THREE + mix64(q[j])))
        place.append(j - 1)
    return np.concatenate(keys), np.concatenate(place).astype(np.int32)


def parity(s: np.ndarray) -> bytes:
    """Bitmap whose bits are the parity of the elements hashed to them: two
    bitmaps differ in at most as many bits as the sets in elements.  It has a
    bit an element at least, so it tells large sets apart as well."""
    width = max(BITMAP_BITS, 1 << max(0, len(s) - 1).bit_length())
    bit = (s >> np.uint64(65 - width.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=width) & 1).astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded, neighbours
    onto each other, which is the bitmap of the same set at half the width."""
    if len(x) < len(y):
        x, y = y, x
    wide, narrow = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(wide) > len(narrow):
        bits = np.unpackbits(wide)
        wide = np.packbits(bits[0::2] ^ bits[1::2])
    return int(np.bitwise_count(wide ^ narrow).sum())


def describe(docs: DataFrame, key: str, level: np.ndarray, edge: int, k: int,
             percent: int) -> DataFrame:
    """Staged (id, f, i, doc_id, n, digest, bits, keys, places) of every row;
    ``key`` is the row key of ``docs``."""
    rows = docs.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(key)["f"].alias("f"), F.col(key)["i"].alias("i"))

    def run(batches):
        for b in batches:
            for s in parts(b):
                sets = shingle_sets(*text_buffer(s.column(0)), k)
                keys, places = [], []
                for x in sets:
                    a, p = (ordered_keys(x, level, percent, edge) if len(x)
                            else (x, np.zeros(0, np.int32)))
                    keys.append(a.view(np.int64))
                    places.append(p)
                cut = np.concatenate([[0], np.cumsum([len(a) for a in keys])]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                place = np.concatenate(places) if places else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [s.column(1), s.column(2), s.column(3),
                     pa.array([len(x) for x in sets], pa.int32()),
                     pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                               for x in sets], pa.binary()),
                     pa.array([parity(x) for x in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(place))],
                    ["doc_id", "f", "i", "n", "digest", "bits", "keys", "places"])

    kind = ("doc_id long, f string, i long, n int, digest binary, bits binary, "
            "keys array<long>, places array<int>")
    return stage(rows.mapInArrow(run, kind)
                 .withColumn("id", F.monotonically_increasing_id()), "shingle-sets")


def classes(rows: DataFrame) -> DataFrame:
    """Staged (digest, cls, copies, first_doc): one row per distinct set; cls
    is the id of one of its rows."""
    return stage(rows.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("cls"), F.count("*").alias("copies"),
        F.min("doc_id").alias("first_doc")), "shingle-classes")


def lists(rows: DataFrame, cls: DataFrame) -> DataFrame:
    """Staged (key, place, cls, n, centre, centre_n, centre_place): the places
    of every key that two classes at least have, with the list's centre: the
    class with the most copies, then the smallest place."""
    one = rows.select("id", "n", "keys", "places").join(
        cls.select(F.col("cls").alias("id"), "copies"), "id")
    flat = one.select(F.col("id").alias("cls"), "n", "copies",
                      F.explode(F.arrays_zip("keys", "places")).alias("k")).select(
        "cls", "n", "copies", F.col("k.keys").alias("key"), F.col("k.places").alias("place"))
    whole = (W.partitionBy("key").orderBy(F.desc("copies"), "place", "cls")
             .rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    named = flat.select("key", "place", "cls", "n",
                        F.count("*").over(whole).alias("m"),
                        F.first(F.struct("cls", "n", "place")).over(whole).alias("c"))
    return stage(named.where("m > 1").select(
        "key", "place", "cls", "n", F.col("c.cls").alias("centre"),
        F.col("c.n").alias("centre_n"), F.col("c.place").alias("centre_place")), "shingle-lists")


def possible(n_a: str, place_a: str, n_b: str, place_b: str, percent: int) -> str:
    """Condition: sets that first meet at these places of their prefixes can
    still share enough: |A n B| * (100 + p) >= p * (|A| + |B|)."""
    need = f"{percent} * ({n_a} + {n_b})"
    share = f"{100 + percent}"
    return (f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b}) "
            f"AND {share} * ({n_a} - {place_a}) >= {need} "
            f"AND {share} * ({n_b} - {place_b}) >= {need}")


def verify(pairs: DataFrame, rows: DataFrame, docs: DataFrame, key: str, k: int,
           percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose sets reach the threshold.  The
    bitmaps rule out most others; the sets of the classes that are left are
    made from their texts again, which is less than to keep them all.  The
    texts are found by the row key that ``rows`` was described with."""
    bits = rows.select("id", "n", "bits")
    near = (pairs.join(bits.select(F.col("id").alias("a"), F.col("n").alias("n_a"),
                                   F.col("bits").alias("bits_a")), "a")
            .join(bits.select(F.col("id").alias("b"), F.col("n").alias("n_b"),
                              F.col("bits").alias("bits_b")), "b"))

    def differ(batches):
        for b in batches:
            apart = np.array([bits_apart(x, y) for x, y in zip(
                b.column(4).to_pylist(), b.column(5).to_pylist())], np.int64)
            n = (b.column(2).to_numpy() + b.column(3).to_numpy()).astype(np.int64)
            # |A n B| = (|A| + |B| - apart) / 2 at most
            ok = (100 + percent) * (n - apart) >= 2 * percent * n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)],
                                             ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = stage(near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
                 .mapInArrow(differ, "a long, b long"), "near-pairs")
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    places = rows.select("id", "f", "i").join(wanted, "id")
    texts = docs.select(
        F.col("text").cast("string").alias("text"), F.col(key)["f"].alias("f"),
        F.col(key)["i"].alias("i")).join(places, ["f", "i"]).select("id", "text")

    def sets_of(batches):
        for b in batches:
            for s in parts(b):
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([x.tobytes() for x in
                                            shingle_sets(*text_buffer(s.column(1)), k)],
                                           pa.binary())], ["id", "s"])

    sets = stage(texts.mapInArrow(sets_of, "id long, s binary"), "near-sets")
    full = (near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b"))

    def overlap(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x = np.frombuffer(x.as_py(), np.uint64)
                y = np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)],
                                             ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return stage(full.select("a", "b", "s_a", "s_b").mapInArrow(overlap, "a long, b long"),
                 "links")


def star_pairs(places: DataFrame, percent: int) -> DataFrame:
    """Every class of a list with the list's centre."""
    return (places.where("cls <> centre")
            .where(possible("n", "place", "centre_n", "centre_place", percent))
            .select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b"))
            .distinct())


def cross_pairs(places: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list whose classes are in different components.

    The component with the most places in a list stays on one side of the
    join, so its members never meet each other."""
    named = (places.select("key", "place", "cls", "n")
             .join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
             .withColumn("root", F.coalesce("root", "cls")))
    named = stage(named, "list-components")
    count = named.groupBy("key", "root").agg(F.count("*").alias("m"))
    main = count.groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"),
                                    F.count("*").alias("roots"))
    main = main.where("roots > 1").select("key", F.col("main.root").alias("main"))
    mixed = stage(named.join(main, "key"), "mixed-lists")
    few = mixed.where("root <> main").select(
        "key", F.col("place").alias("pa"), F.col("cls").alias("ca"), F.col("n").alias("na"),
        F.col("root").alias("ra"))
    many = mixed.select("key", F.col("place").alias("pb"), F.col("cls").alias("cb"),
                        F.col("n").alias("nb"), F.col("root").alias("rb"), "main")
    on = F.expr("key_a = key AND ra <> rb AND (rb = main OR ca < cb) AND "
                + possible("na", "pa", "nb", "pb", percent))
    return (few.withColumnRenamed("key", "key_a").join(many, on)
            .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row key, and the key's name.  Called once for a join:
    everything that is found or dropped by a row's place needs the same keys."""
    key = free_name(docs, "row_key")
    return with_row_key(docs, key), key


def similarity_classes(docs: DataFrame, key: str, k: int = 5,
                       percent: int = 80) -> dict[str, DataFrame]:
    """The whole join of documents that have the row key ``key``.

    rows: every document (doc_id, f, i, n, cls); classes: cls, copies,
    first_doc; links: verified pairs (a, b) of classes, enough to connect each
    component; roots: (cls, root) of linked classes."""
    level, sizes, counts = sketch(docs, k)
    rows = describe(docs, key, level, boundary(sizes, counts, percent), k, percent)
    cls = classes(rows)
    places = lists(rows, cls)
    star = verify(star_pairs(places, percent), rows, docs, key, k, percent)
    roots = components(star)
    cross = cross_pairs(places, roots, percent)
    links = star.union(verify(cross, rows, docs, key, k, percent))
    merged = components(links)
    return {"rows": rows, "classes": cls, "links": links, "roots": merged}


def all_links(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Every linked pair of distinct sets as (doc_a, doc_b) of their smallest
    doc_ids, components left out of account.  The result itself grows with the
    square of a group of near copies; components do not need it."""
    docs, key = keyed_rows(docs)
    level, sizes, counts = sketch(docs, k)
    rows = describe(docs, key, level, boundary(sizes, counts, percent), k, percent)
    cls = classes(rows)
    alone = rows.sparkSession.createDataFrame([], "node long, root long")
    pairs = cross_pairs(lists(rows, cls), alone, percent)
    links = verify(pairs, rows, docs, key, k, percent)
    name = cls.select("cls", "first_doc")
    return (links.join(name.toDF("a", "doc_a"), "a").join(name.toDF("b", "doc_b"), "b")
            .select(F.least("doc_a", "doc_b").alias("doc_a"),
                    F.greatest("doc_a", "doc_b").alias("doc_b")))


def component_rows(join: dict[str, DataFrame]) -> DataFrame:
    """(f, i, id, doc_id, n, cls_doc, root, component): each row with the
    smallest doc_id of its class and of its component; an empty set stands for
    itself."""
    cls = join["classes"].join(join["roots"].withColumnRenamed("node", "cls"), "cls", "left")
    cls = cls.withColumn("root", F.coalesce("root", "cls"))
    top = cls.groupBy("root").agg(F.min("first_doc").alias("component"))
    cls = cls.join(top, "root").select("digest", F.col("first_doc").alias("cls_doc"), "root",
                                       "component")
    alone = F.col("root").isNull()
    return (join["rows"].select("f", "i", "id", "doc_id", "n", "digest")
            .join(cls, "digest", "left")
            .select("f", "i", "id", "doc_id", "n",
                    F.when(alone, F.col("doc_id")).otherwise(F.col("cls_doc")).alias("cls_doc"),
                    F.coalesce("root", "id").alias("root"),
                    F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
                    .alias("component")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row."""
    docs, key = keyed_rows(docs)
    out = component_rows(similarity_classes(docs, key, k, percent))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.col("component").alias("component_id"), F.col("cls_doc").alias("class_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component (the
    first row of it), all columns unchanged; documents without words all stay.
    Only the dropped rows' places are joined back."""
    docs, key = keyed_rows(docs)
    out = component_rows(similarity_classes(docs, key, k, percent))
    best = out.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("best"))
    gone = out.join(best, "root").where(F.col("id") != F.col("best.id"))
    gone = gone.select(F.struct("f", "i").alias(key))
    return docs.join(gone, key, "left_anti").drop(key)

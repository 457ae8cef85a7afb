"""SimHash near-duplicates by pivot distance tables (operator 6).

Every distinct fingerprint gets a table row of its Hamming distances to fixed
reference fingerprints (pivots), kept per slice of bits; the full distance is
the sum over the slices.  By the triangle inequality two fingerprints within
``bits`` of each other differ by at most ``bits`` in every full distance, so a
larger maximum coordinate difference discards a pair.  To meet without forming
all pairs the table is looked up by two slices at a time: with ``bits`` + 2
slices, fingerprints within ``bits`` agree on two slices wholly, and so in all
coordinates of those.  Survivors are verified bit by bit.  No link is lost.

Copies share a fingerprint and are one class; only classes are linked.

The pipeline asks for a Jaccard similarity of shingle sets instead (``keep_similar_first``).
There, too, the fingerprints within ``bits`` meet by the pivot tables.  But at 0.8
they differ in 10 of 64 bits on average and often in 16; slices for so many bits
are so short that nearly all pairs meet.  So the rest meets in bands of shingle
minima, and the exact similarity decides for both.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.llm.common import alone, small_batches, with_result
from pagework.llm.links import components
from pagework.plans.stage import stage

SHINGLE = 3
BITS = 3
SEED = 42
PIVOTS = 16
AT_ONCE = 1 << 16  # shingle hashes whose bits are spread out at once
# A pair of similarity 0.8 shares one of 20 bands of 5 minima with probability 0.9996.
ALIKE = 0.8
LONG_SHINGLE = 5
BANDS = 20
BAND_ROWS = 5


def pivots(count: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints, as signed 64-bit numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % i)).astype(np.int64)) for i in range(count)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words; of a shorter text the whole."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    size = min(shingle, len(words))
    n = len(words) - size + 1
    windows = zip(*[words[i : i + n] for i in range(size)], strict=True)
    return np.fromiter((digest(b" ".join(w), SEED) for w in windows), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; zero for a text without words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``, signed; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        part = hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """Append ``simhash`` (bigint).  Null, empty and blank texts get zero."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<simhash: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        alone("simhash")
        out = [fingerprint(t.as_py(), shingle) for t in texts]
        return pa.StructArray.from_arrays([pa.array(out, pa.int64())], ["simhash"])

    return with_result(docs, run(F.col(text)), ["simhash"])


def _masks(slices: int) -> list[int]:
    """Bit masks of ``slices`` nearly equal parts of 64 bits, signed."""
    edges = [64 * i // slices for i in range(slices + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct values of ``simhash`` that differ in
    at most ``bits`` bits, each once."""
    value, points, slices = F.col("simhash"), pivots(), bits + 2
    near = [[F.bit_count((value.bitwiseXOR(F.lit(p))).bitwiseAND(F.lit(m))) for p in points] for m in _masks(slices)]
    table = classes.select("simhash", *[F.array(*row).alias(f"s{i}") for i, row in enumerate(near)])
    # Full distances fit seven bits each; nine are packed in a number.
    full = [reduce(lambda a, b: a + b, [F.col(f"s{i}")[p] for i in range(slices)]).cast("bigint") for p in range(len(points))]
    packs = [full[i : i + 9] for i in range(0, len(full), 9)]
    packed = [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(d, 7 * k) for k, d in enumerate(pack)]) for pack in packs]
    keys = [F.xxhash64(F.lit(i), F.lit(j), f"s{i}", f"s{j}") for i, j in combinations(range(slices), 2)]
    table = table.select("simhash", *[p.alias(f"t{n}") for n, p in enumerate(packed)], F.explode(F.array(*keys)).alias("key"))

    def coordinate(side: str, n: int, k: int) -> Column:
        return F.shiftright(F.col(f"{side}.t{n}"), 7 * k).bitwiseAND(F.lit(127))

    close = [F.abs(coordinate("x", n, k) - coordinate("y", n, k)) <= bits for n, pack in enumerate(packs) for k in range(len(pack))]
    exact = F.bit_count(F.col("x.simhash").bitwiseXOR(F.col("y.simhash"))) <= bits
    met = table.alias("x").join(table.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.simhash") < F.col("y.simhash")) & _all(close) & exact)
    return met.select(F.col("x.simhash").alias("a"), F.col("y.simhash").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, text: str = "text", key: Column | None = None) -> DataFrame:
    """(doc_id, simhash, component_id) per row of ``docs``; component_id is the
    smallest doc_id that links of at most ``bits`` bits reach.  ``key`` is carried
    along where it is given.

    Texts without words have the fingerprint zero and link like any other.  Rows
    with a null doc_id have a fingerprint and a component (null if nothing in it
    has an id).  Repeated rows give repeated results; an empty table none.  A
    fingerprint that a third of all rows share is one class: it is reduced before
    the shuffle, and the join that hands out its component is left to skew
    splitting.
    """
    carried = [] if key is None else [key.alias("key")]
    rows = stage(fingerprints(docs.select("doc_id", text, *carried), shingle, text).drop(text), "simhash")
    classes = stage(rows.groupBy("simhash").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes, bits))
    placed = classes.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left")
    placed = placed.withColumn("root", F.coalesce("root", "simhash"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.select("simhash", "root").join(least, "root").select("simhash", "component_id")
    return rows.join(known, "simhash").select("doc_id", "simhash", "component_id", *rows.columns[1:-1])


def hexadecimal(value: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(value)), 16, "0"))


FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima over a shingle set (signed 64-bit)."""
    minima = np.full(len(FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), AT_ONCE // len(FACTORS)):
        mixed = hashes[None, at : at + AT_ONCE // len(FACTORS)] * FACTORS
        mixed ^= mixed >> np.uint64(31)
        np.minimum(minima, mixed.min(axis=1), out=minima)
    rows = minima.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def alike(docs: DataFrame, shingle: int = LONG_SHINGLE, least: float = ALIKE, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, root) of the rows with an id: ``root`` names the component of texts
    whose shingle sets have a Jaccard similarity of ``least`` or more.

    Texts with one shingle set are one class; classes meet by their fingerprints
    and in bands, every pair that meets is verified by its exact similarity.  Only
    the shingles of classes that meet another are written, made anew from the text.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<node: bigint, size: int, simhash: bigint, keys: array<bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        alone("simhash")
        nodes, sizes, prints, keys = [], [], [], []
        for t in texts:
            own = np.unique(shingle_hashes(t.as_py(), shingle))
            nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
            sizes.append(len(own))
            prints.append(majority(own))
            keys.append(band_keys(own) if len(own) else np.empty(0, np.int64))
        arrays = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                  pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(arrays, ["node", "size", "simhash", "keys"])

    @F.arrow_udf("binary")
    def shingles(texts: pa.Array) -> pa.Array:
        alone("simhash")
        return pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in texts], pa.binary())

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(common >= least * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    known = docs.where(F.col("doc_id").isNotNull())
    rows = stage(known.select("doc_id", F.xxhash64(text).alias("text_hash"), cut(text).alias("r")).select(
        "doc_id", "text_hash", "r.*"), "shingles")
    # One document speaks for its class.
    speaks = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = rows.groupBy("node").agg(speaks, F.first("size").alias("size"), F.first("simhash").alias("simhash"))
    classes = stage(classes.where("size > 0"), "shingle-classes")
    # By fingerprints: classes of one fingerprint meet its least, and those meet by pivot tables.
    least_of = classes.groupBy("simhash").agg(F.min("node").alias("of"))
    same = classes.join(least_of, "simhash").where("node <> of").select(F.col("of").alias("a"), F.col("node").alias("b"))
    near = links(stage(least_of.select("simhash"), "shingle-prints"))
    near = near.join(least_of.select(F.col("simhash").alias("a"), F.col("of").alias("x")), "a").join(
        least_of.select(F.col("simhash").alias("b"), F.col("of").alias("y")), "b").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # By bands.
    spoken = rows.join(classes.select("node", "first").hint("merge"), "node").where(
        "doc_id = first.doc_id AND text_hash = first.text_hash")
    keyed = spoken.select("node", "size", "keys").dropDuplicates(["node"]).select("node", "size", F.explode("keys").alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    # Sets of too different sizes cannot be alike.
    sizes = F.least("x.size", "y.size") >= F.lit(least) * F.greatest("x.size", "y.size")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & sizes)
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = stage(met.unionByName(same).unionByName(near).distinct(), "shingle-pairs")
    held = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    speakers = classes.join(held.hint("merge"), "node", "left_semi").select(
        "node", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__of"))
    texts = known.select("doc_id", F.col(text).alias("__text"), F.xxhash64(text).alias("__hash")).join(
        speakers.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__of")))
    again = F.row_number().over(Window.partitionBy("__id", "__of").orderBy("__id"))
    once = texts.withColumn("__again", again).where("__again = 1")
    sets = stage(once.select("node", shingles("__text").alias("hashes")), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")).hint("merge"), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")).hint("merge"), "b")
    roots = components(both.where(similar("left", "right")).select("a", "b"))
    placed = rows.select("doc_id", "text_hash", "node").join(roots, "node", "left")
    return placed.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def keep_similar_first(docs: DataFrame, shingle: int = LONG_SHINGLE, least: float = ALIKE, text: str = "text") -> DataFrame:
    """Like ``keep_first``, by similarity of shingle sets."""
    return _first_of(docs, alike(docs, shingle, least, text), text)


def keep_first(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, text: str = "text") -> DataFrame:
    """The documents without near-duplicates of an earlier one: of each component
    the smallest doc_id stays.  An id that repeats with other texts is another
    document each time, and the same id and text again are the same document.
    Rows with a null doc_id stay as they are."""
    placed = near_duplicates(docs, shingle, bits, text, key=F.xxhash64(text))
    return _first_of(docs, placed.select("doc_id", F.col("key").alias("text_hash"), F.col("component_id").alias("root")), text)


def _first_of(docs: DataFrame, placed: DataFrame, text: str) -> DataFrame:
    """Once each document (doc_id, text_hash) with the least id, and of several texts
    of that id the least hash, of its ``root``; and all rows with a null doc_id.
    Texts move once: the join's partitions serve the rank as well."""
    placed = placed.where(F.col("doc_id").isNotNull())
    first = placed.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__of")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("__text", F.xxhash64(text))
    met = named.join(kept.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__of")))
    again = F.row_number().over(Window.partitionBy("__id", "__of").orderBy("__id"))
    return met.withColumn("__again", again).where("__again = 1").select(*columns).unionByName(docs.where(F.col("doc_id").isNull()))

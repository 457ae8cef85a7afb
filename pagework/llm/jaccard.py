"""N-gram Jaccard join by parity sketches (operator 12).

A document is the set of its word shingles.  Each shingle's hash picks one bit of
a sketch, and bits are combined by XOR: a bit says whether an odd number of
shingles chose it.  What two sets share cancels out, so the sketches differ in at
most as many bits as the sets differ in shingles, and a similarity bounds that
number from the two sizes.

Sizes are dealt into bands.  In a band at most ``reach`` shingles differ, so of
the ``reach + spare + 1`` words of 64 bits that a band's sketch has, two alike
documents share at least ``spare + 1`` whole words (pigeonhole).  Words are
compared by the XOR of their shingles' full hashes, of which the bits are a part.  A
document leaves out its ``spare`` most frequent words; the rarest shared word
stays on both sides, so no link is lost, and words that boilerplate or chance
makes common pair nothing.

A document whose partner may lie in the band below has words of that band too.
Documents with one set are one class.  Classes that share a word are first linked
to one holder of it; only holders that are then still in other components than most
of the word's holders are looked at again.  Pairs whose parity sketches of WORDS
words differ in too many bits never leave the join, and the exact similarity of the
sets decides on the others.  A group of near copies does not form all its pairs;
one whose members are nearly, but not quite, alike still compares their sketches.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.llm.common import alone, small_batches
from pagework.llm.links import components
from pagework.plans.stage import stage

SHINGLE = 4
PERCENT = 85  # least similarity
SEED = 12
GROWTH = 1.5  # of the sizes from band to band
SPARE = 0.125  # spare words of a band's sketch, as a share of its reach
WORDS = 16  # of the sketch that discards pairs
FACTS = "node: bigint, size: bigint, sketch: array<bigint>, entries: array<struct<band: int, keys: array<bigint>>>"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``shingle`` words; of a shorter text
    the whole."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle, len(words))
    n = len(words) - size + 1
    runs = map(b" ".join, zip(*[words[i : i + n] for i in range(size)], strict=True))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(run, SEED) for run in runs), np.uint64, n))


def farthest(a: int, b: int, percent: int) -> int:
    """Most shingles that sets of ``a`` and ``b`` can differ in at this similarity:
    with d of them, 100 (a + b - d) >= percent (a + b + d)."""
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Bands of set sizes: the first size of each, and what its sketches need."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.first = percent, [1]

    def _grow(self, size: int) -> None:
        while self.first[-1] <= size:
            self.first.append(max(self.first[-1] + 1, int(self.first[-1] * GROWTH), -(-self.first[-1] * 100 // self.percent)))

    def of(self, size: int) -> list[int]:
        """The band of a size, and the one below if a partner may lie there."""
        self._grow(size)
        own = int(np.searchsorted(self.first, size, "right")) - 1
        below = own > 0 and (self.first[own] - 1) * 100 >= self.percent * size
        return [own, own - 1] if below else [own]

    def reach(self, band: int) -> int:
        """Most shingles in which a set of the band and a larger one differ."""
        self._grow(self.first[band] if band < len(self.first) else 1)
        largest = self.first[band + 1] - 1
        return farthest(largest, largest * 100 // self.percent, self.percent)

    def spare(self, band: int) -> int:
        return int(self.reach(band) * SPARE) + 1

    def spares(self, size: int) -> Column:
        """``spare`` by the column ``band``, for sizes up to ``size``."""
        pairs = ((b, self.spare(b)) for b in range(self.of(size)[0] + 1))
        return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col("band")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity sketch of WORDS words."""
    bits = np.zeros(WORDS, np.uint64)
    np.bitwise_xor.at(bits, hashes >> np.uint64(6) & np.uint64(WORDS - 1), np.uint64(1) << (hashes & np.uint64(63)))
    return bits


def keys(hashes: np.ndarray, band: int, reach: int, spare: int) -> np.ndarray:
    """Keys of the words of a band's sketch."""
    n = reach + spare + 1
    sums = np.zeros(n, np.uint64)
    np.bitwise_xor.at(sums, (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), hashes)
    return _mixed(sums ^ _mixed(np.arange(n, dtype=np.uint64) + np.uint64(band << 32)))


def _facts(texts: pa.Array, shingle: int, bands: Bands) -> pa.Array:
    nodes, sizes, sketches, entries = [], [], [], []
    for value in texts:
        own = shingle_set(value.as_py(), shingle)
        nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
        sizes.append(len(own))
        sketches.append(sketch(own).view(np.int64))
        # Without reach only equal sets are alike.
        near = [band for band in bands.of(len(own)) if bands.reach(band)] if len(own) else []
        entries.append([{"band": band, "keys": keys(own, band, bands.reach(band), bands.spare(band)).view(np.int64)} for band in near])
    kind = pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.list_(pa.int64()))]))
    arrays = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(entries, kind)]
    return pa.StructArray.from_arrays(arrays, ["node", "size", "sketch", "entries"])


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, size, sketch, entries) per row: the class of its
    shingle set, the set's size, its sketch, and the keys of its bands."""
    small_batches(docs.sparkSession)
    bands = Bands(percent)

    @F.arrow_udf(f"struct<{FACTS}>")
    def run(texts: pa.Array) -> pa.Array:
        alone("jaccard")
        return _facts(texts, shingle, bands)

    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), run(text).alias("r")).select("doc_id", "text_hash", "r.*")


def _kept_keys(entries: DataFrame, spare: Column) -> DataFrame:
    """(key, node, band): words that several rows share, without the ``spare`` most
    frequent ones of every sketch."""
    keyed = entries.select("node", "band", F.explode("keys").alias("key"))
    # Counts are reduced before the shuffle; any order of the words would do.
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Rows of one class repeat its words.
    shared = keyed.join(counts.hint("merge"), "key").distinct()
    frequent = Window.partitionBy("node", "band").orderBy(F.col("n").desc(), F.col("key"))
    return shared.withColumn("place", F.row_number().over(frequent)).where(F.col("place") > spare).select("key", "node", "band")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches allow a link."""
    n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
    differing = [F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(WORDS)]
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes & (reduce(add, differing) * (100 + percent) <= (n + m) * (100 - percent))


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs of classes whose sets are alike.  ``texts`` has a text of every
    class (node, text); those of classes in no pair are moved once at most."""

    @F.arrow_udf("binary")
    def sets(column: pa.Array) -> pa.Array:
        alone("jaccard")
        return pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in column], pa.binary())

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    held = texts.select("node", sets("text").alias("hashes"))
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("left")).hint("merge"), "a")
    both = both.join(held.select(F.col("node").alias("b"), F.col("hashes").alias("right")).hint("merge"), "b")
    return both.where(similar("left", "right")).select("a", "b")


def sketches_of(text: str, shingle: int, bands: Bands) -> Column:
    """The class (node) of a text's shingle set, the set's size, and its sketches."""

    @F.arrow_udf(f"struct<node: bigint, size: bigint, entries: {ENTRIES}>")
    def run(texts: pa.Array) -> pa.Array:
        alone("jaccard")
        return _sketched(texts, shingle, bands)

    return run(F.col(text))


def _across(kept: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, band, node, root, main) of the words whose holders are in several
    components; ``main`` is the one with most holders."""
    placed = kept.join(roots.hint("merge"), "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
    return placed.join(largest.where("parts > 1").select("key", "main").hint("merge"), "key")


def links(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """(node, root) of the classes of ``rows`` that are linked to another: ``root``
    names their component."""
    size = rows.agg(F.max("size")).first()[0] or 1
    entries = rows.where(F.size("entries") > 0).select("node", F.explode("entries").alias("e")).select("node", "e.*")
    kept = stage(_kept_keys(entries, Bands(percent).spares(size)), "parity-words")
    # What one class holds alone after the choice of words pairs nothing.
    most = kept.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("rep"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    holders = stage(kept.join(most.where("lo < hi").select("key", "rep").hint("merge"), "key"), "holders")
    # One row, and one text, speaks for its class.
    held = rows.join(holders.select("node").distinct().hint("merge"), "node", "left_semi")
    row = F.min(F.struct("doc_id", "text_hash")).alias("row")
    facts = stage(held.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), row), "sketches")
    wanted = facts.select("node", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("of"))
    found = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("of")))
    texts = stage(found.select("node", F.col(text).alias("text")).dropDuplicates(["node"]), "class-texts")
    stars = holders.where("node <> rep").select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
    sketches = facts.drop("row")
    x, y = sketches.alias("x"), sketches.alias("y")
    met = stars.join(x.hint("merge"), F.col("a") == F.col("x.node")).join(y.hint("merge"), F.col("b") == F.col("y.node"))
    near = stage(met.where(_may_link("x", "y", percent)).select("a", "b"), "near-stars")
    first = stage(_alike(near, texts, shingle, percent), "star-links")
    # Linked classes that are not in one component yet share a word across components.
    split = _across(holders.drop("rep"), components(first))
    split = stage(split.join(sketches.hint("merge"), "node"), "split-words")
    x, y = split.where("root <> main").alias("x"), split.alias("y")
    other = (F.col("x.key") == F.col("y.key")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.root") < F.col("y.root")))
    pairs = x.join(y.hint("merge"), other & _may_link("x", "y", percent))
    pairs = stage(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "near-pairs")
    second = _alike(pairs.join(near.hint("merge"), ["a", "b"], "left_anti"), texts, shingle, percent)
    return components(first.unionByName(second))


def alike_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``; component_id is the
    smallest doc_id that links of ``percent`` similarity or more reach.

    Words are lower-cased in A-Z and end at ASCII blanks.  Null, empty and blank
    texts have no shingles and are linked with nothing: their component is their
    own id.  Rows with a null doc_id link others, and have a null component if
    nothing in it has an id.  Repeated rows give repeated results; an empty table
    gives an empty one; other columns are ignored.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    rows = stage(classes(docs, shingle, percent), "parity-sketches")
    roots = links(docs, rows, shingle, percent)
    placed = rows.select("doc_id", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "root", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

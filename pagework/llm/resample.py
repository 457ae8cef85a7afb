"""Target-distribution importance resampling (operator 11).

Hashed n-gram counts of a target set and of the raw documents give every bucket
a gain, the log ratio of its two smoothed shares; a document's weight is the sum
of its features' gains.  Adding Gumbel noise that only the id decides and taking
the highest scores draws without replacement, in proportion to exp(weight).

Words come from the bytes: one table of 256 entries lower-cases and blanks all
separators, ``split`` does the rest.  The checksum of an n-gram goes on from the
one of its first words: zlib.crc32 takes it as its seed.  Counters reduce what a
task has seen before anything is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import alone, numbered, small_batches, with_result
from pagework.plans.stage import stage

BUCKETS = 10_000
WORDS_AT_ONCE = 1 << 16
LONGEST = 3  # words of a feature
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SCALE = 1000

# Fixed value: what a word is made of; every other byte separates.
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TABLE = bytes(b if b in LETTERS else 0x20 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def checksums(words: list[bytes]) -> Iterator[list[int]]:
    """crc32 of all runs of 1 to LONGEST words, joined by a blank, in parts."""
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + LONGEST - 1]
        starts = min(WORDS_AT_ONCE, len(words) - at)
        longer = [b" " + w for w in part]
        sums = list(map(zlib.crc32, part[:starts]))
        yield sums
        for n in range(1, LONGEST):
            sums = list(map(zlib.crc32, longer[n:], sums))
            yield sums


def buckets(words: list[bytes]) -> Iterator[np.ndarray]:
    for sums in checksums(words):
        yield np.array(sums, np.int64) % BUCKETS


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts in every bucket that has any.  A task
    sends one row per bucket at most."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("resample")
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                for found in buckets(words_of(value.as_py())):
                    seen.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int32()), pa.array(seen.values(), pa.int64())], ["bucket", "n"])

    parts = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> np.ndarray:
    """The gain of each of the BUCKETS buckets, which is all the driver sees."""
    spark = docs.sparkSession
    raw = bucket_counts(docs, text).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, target_text).withColumnRenamed("n", "t")
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(raw, "bucket", "left").join(wanted, "bucket", "left").fillna(0, ["s", "t"]).toArrow().sort_by("bucket")
    s, t = (rows[name].to_numpy().astype(np.float64) for name in ("s", "t"))
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """Append ``n_words``, ``n_features`` and ``weight``, the sum of the features'
    gains.  Null and empty texts have no features and weigh nothing."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_words: bigint, n_features: bigint, weight: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        alone("resample")
        out = np.zeros((3, len(texts)), np.int64)
        for i, value in enumerate(texts):
            words = words_of(value.as_py())
            out[0, i] = len(words)
            for found in buckets(words):
                out[1, i] += len(found)
                out[2, i] += gain[found].sum()
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n_words", "n_features", "weight"])

    return with_result(docs, run(F.col(text)), ["n_words", "n_features", "weight"])


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise, in units of 1 / SCALE, of an id (null: the empty text)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``.

    ``percent`` of the rows with ``least_words`` words or more are drawn: those of
    the highest scores, ties to the smaller doc_id (a null one comes last) and then
    to the smaller hash of the text.  ``rank`` counts them from 1; it is null for
    all others.  Null texts are empty; repeated rows count each time; columns of
    other names are ignored; an empty table gives an empty result, and an empty
    target is a uniform one.

    Ranks come from a sort over all tasks: no task sees more than its range.
    """
    scored = weighed(docs.select("doc_id", F.col(text).alias("text")), gains(docs, target, text, target_text), "text")
    scored = scored.select("doc_id", F.xxhash64("text").alias("of"), "n_words", "n_features", "weight", (F.col("weight") + noise()).alias("score"))
    scored = stage(scored.withColumn("enters", F.col("n_words") >= least_words), "weights")
    order = [F.col("enters").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("of").asc()]
    placed = numbered(scored, order, "rank")
    drawn = scored.where("enters").count() * percent // 100
    rank = F.when(F.col("enters") & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.plans.stage import stage

ROWS_PER_BATCH = 250
BYTES_PER_BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def with_result(df: DataFrame, result: Column, names: Sequence[str]) -> DataFrame:
    """Append the fields ``names`` of the struct ``result``.  Columns of ``df``
    that have one of these names are replaced."""
    kept = [c for c in df.columns if c not in names]
    return df.withColumn("__result", result).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col("__result")[n].alias(n) for n in names]
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Append ``name``: the place of each row in ``order``, from 1.

    The rows are dealt out by ranges of the order and sorted inside them; the
    driver sees one count per range.  ``df`` is read twice (once for the ranges),
    so callers stage what is dear to compute.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # This id counts the rows inside a partition, below the partition's number.
    rows = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "places").withColumn("__part", F.shiftright("__at", 33))
    sizes = sorted(rows.groupBy("__part").count().collect())
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    offsets = F.broadcast(spark.createDataFrame(starts, "__part bigint, __before bigint"))
    place = F.col("__at") - F.shiftleft("__part", 33) + F.col("__before") + 1
    return rows.join(offsets, "__part").select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


_MADE: dict = {}
# Where the C library can hand back the pages of freed objects, it is told to.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def alone(operator: str) -> None:
    """Let go of what other operators have left in this Python worker, which the
    stages of a job share, and give the freed memory back to the system."""
    if _MADE.get("operator") != operator:
        _MADE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if TRIM:
            TRIM(0)
        _MADE["operator"] = operator


def once(operator: str, name: str, key, make: Callable):
    """One instance per Python worker, as long as the operator stays the same."""
    alone(operator)
    if _MADE.get(name, (None,))[0] != key:
        _MADE[name] = (key, make())
    return _MADE[name][1]


class Bounded(dict):
    """A memo of ``make(key)`` that starts anew when it holds ``limit`` entries."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(dict):
    """A memo of ``make(key)`` that forgets what was not asked for lately: when it
    holds ``limit`` entries they become the older half, in which keys are looked up
    before they are made again, and the older half so far goes."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

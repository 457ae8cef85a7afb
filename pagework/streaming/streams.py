"""Structured Streaming forms of the incremental operators.

Micro-batches are kept as rows in a bucketed table, one row per key, and what
they change is folded again from all rows of the touched groups.  So rows may
arrive late, twice or in any order, and the batch forms give the same results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.functions.text import bound
from pagework.operators import chunks as K
from pagework.operators.state import latest
from pagework.plans.running import keep_first
from pagework.plans.stage import stage

BUCKETS = 64
PLAIN = "[A-Za-z0-9$+<=>^`|~]"  # characters between which words need a blank


def shared_ends(before: Column, after: Column) -> Column:
    """Length of the longest end of ``before`` that starts ``after``.  Only as
    much of ``before`` is looked at as one recognised utterance is long."""

    def longest(pair: Column) -> Column:
        sizes = F.sequence(F.lit(0), F.least(F.length(pair["end"]), F.length(pair["start"])))
        same = F.filter(sizes, lambda n: F.right(pair["end"], n) == F.left(pair["start"], n))
        return F.array_max(same)

    return bound(F.struct(F.right(before, F.length(after)).alias("end"), after.alias("start")), longest)


def continued(before: Column, after: Column) -> Column:
    """Text of two recognised pieces: what both share is written once, a piece
    that repeats or continues the other stands for both, and plain words that
    share nothing are parted by a blank."""

    def put_together(n: Column) -> Column:
        parted = (n == 0) & F.right(before, F.lit(1)).rlike(PLAIN) & F.left(after, F.lit(1)).rlike(PLAIN)
        return F.concat(before, F.when(parted, " ").otherwise(""), F.substring(after, n + 1, F.length(after)))

    whole = F.when(F.startswith(after, before), after).when(F.endswith(before, after), before)
    return whole.otherwise(bound(shared_ends(before, after), put_together))


def transcripts(results: DataFrame) -> DataFrame:
    """X1, batch form. (session_id, text, last_seq) of recognition results
    (session_id, seq, is_final, text).  Final results are committed in order; the
    newest provisional one after the last of them closes the text.  A session is
    one speaker's dictation."""
    said = F.trim(F.coalesce("text", F.lit("")))
    row = F.struct("seq", F.coalesce("is_final", F.lit(False)).alias("final"), said.alias("said"))
    sessions = results.groupBy("session_id").agg(
        F.array_sort(F.collect_set(row)).alias("rows"), F.max("seq").alias("last_seq")
    )
    heard = F.filter("rows", lambda r: r["said"] != "")
    committed = F.aggregate(
        F.filter(heard, lambda r: r["final"]), F.lit(""), lambda text, r: continued(text, r["said"])
    )
    newest = F.element_at(F.filter("rows", lambda r: r["said"] != ""), -1)
    live = F.when(F.size(heard) > 0, F.when(~newest["final"], newest["said"])).otherwise(None)
    closed = sessions.select("session_id", committed.alias("committed"), live.alias("live"), "last_seq")
    text = F.when(F.col("live").isNull(), F.col("committed")).otherwise(continued(F.col("committed"), F.col("live")))
    return closed.select("session_id", text.alias("text"), "last_seq")


def join_deltas(deltas: DataFrame) -> DataFrame:
    """X2, batch form. Answer text of each finished request; ``failed`` when it
    stopped at the length limit.  Finished means that the closing delta and all
    before it are there.  An answer is at most 5,000 tokens long."""
    ordered = F.array_sort(F.collect_set(F.struct("seq", F.coalesce("delta", F.lit("")).alias("d"))))
    closing = F.max(F.when(F.col("finish").isNotNull(), F.col("seq")))
    return deltas.groupBy("request_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["d"]), "").alias("text"),
        (F.count_distinct("seq") == closing + 1).alias("done"),
        F.coalesce(F.max(F.col("finish") == "length"), F.lit(False)).alias("failed"),
    ).where("done").drop("done")


def activity(events: DataFrame) -> DataFrame:
    """X3, batch form. Newest opening and position per user and book, and the
    pages whose bookmark was toggled an odd number of times; each event once."""
    action = F.col("action")
    once = events.dropDuplicates(["user_id", "book_id", "event_id"])
    pages = once.groupBy("user_id", "book_id", "page_index").agg(
        F.max(F.when(action == "open", latest())).alias("opened"),
        F.max(
            F.when(action.isin("open", "navigate"), F.struct("ts", "event_id", "page_index"))
        ).alias("seen"),
        F.count(F.when(action == "toggle_bookmark", 1)).alias("toggles"),
    )
    marked = F.collect_list(F.when(F.col("toggles") % 2 == 1, F.col("page_index")))
    return pages.groupBy("user_id", "book_id").agg(
        F.max("opened").alias("opened"), F.max("seen").alias("seen"),
        F.array_sort(marked).alias("bookmarks"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``; other errors are not hidden."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(batch: DataFrame, path: str, keys: list[str], group: list[str] | None = None,
           buckets: int = BUCKETS) -> None:
    """Replace the rows of the batch's keys in a table bucketed by ``group`` (the
    keys by default).  Only buckets that hold such keys are read and rewritten;
    their number is fixed when a table is made and grows with its planned size."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys).withColumn("bucket", bucket_of(group or keys, buckets))
    fresh = stage(fresh, "upsert")
    merged = fresh
    if exists(spark, path):
        touched = spark.read.parquet(path).join(fresh.select("bucket").distinct(), "bucket", "left_semi")
        kept = touched.join(fresh.select(*keys), keys, "left_anti")
        merged = stage(fresh.unionByName(kept.select(*fresh.columns)), "upsert")
    merged.write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(path)


def fold_batch(batch: DataFrame, log: str, out: str, group: list[str], row: list[str],
               fold: Callable[[DataFrame], DataFrame]) -> None:
    """Keep the batch's rows in ``log`` (one per ``group`` and ``row``), fold the
    touched groups from all their rows, and put the results into ``out``."""
    spark = batch.sparkSession
    upsert(batch, log, [*group, *row], group)
    touched = batch.select(*group).distinct().withColumn("bucket", bucket_of(group, BUCKETS))
    rows = spark.read.parquet(log).join(touched, ["bucket", *group], "left_semi").drop("bucket")
    upsert(fold(rows), out, group)


def run_available(stream: DataFrame, mode: str, checkpoint: str,
                  sink: Callable[[DataFrame, int], None]) -> None:
    """Process all files that are there, batch by batch, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def index_batch(pages: DataFrame, chunk_path: str, manifest_path: str, batch_id: int) -> None:
    """X4. Cut new or changed pages only, and write their chunks under the batch;
    the manifest names version, digest and batch of each page.  Batches that are
    run again replace what they wrote."""
    spark = pages.sparkSession
    keys = ["book_id", "page_index"]
    arrived = keep_first(
        pages.withColumn("digest", F.sha2("text", 256)), keys, [F.desc("version")]
    ).withColumn("bucket", bucket_of(keys, BUCKETS))
    fresh = arrived
    if exists(spark, manifest_path):
        known = current_manifest(spark.read.parquet(manifest_path).where(F.col("batch_id") < batch_id))
        known = known.select("bucket", *keys, F.col("digest").alias("_digest"), F.col("version").alias("_version"))
        # Older versions never replace newer ones, whenever they arrive.
        fresh = arrived.join(known, ["bucket", *keys], "left").where(
            "_version IS NULL OR (version > _version AND digest <> _digest)"
        ).drop("_digest", "_version")
    fresh = stage(fresh.withColumn("batch_id", F.lit(batch_id).cast("long")), "fresh-pages")
    none = F.expr("cast(array() as array<string>)")
    segments = fresh.select(
        *keys, F.lit(0).alias("seg_no"), K.chunk_source("text").alias("text"), none.alias("path")
    )
    chunks = K.cut_segments(segments).join(fresh.select(*keys, "digest", "batch_id"), keys)
    dynamic = {"partitionOverwriteMode": "dynamic"}
    chunks.write.partitionBy("batch_id").options(**dynamic).mode("overwrite").parquet(chunk_path)
    entries = fresh.select(*keys, "digest", "version", "bucket", "batch_id")
    entries.write.partitionBy("bucket", "batch_id").options(**dynamic).mode("overwrite").parquet(manifest_path)


def current_manifest(entries: DataFrame) -> DataFrame:
    newest = F.max(F.struct("version", "batch_id", "digest")).alias("_n")
    return entries.groupBy("bucket", "book_id", "page_index").agg(newest).select(
        "bucket", "book_id", "page_index", "_n.*"
    )


def current_chunks(spark: SparkSession, chunk_path: str, manifest_path: str) -> DataFrame:
    """Chunks of the pages as they are now: those of the batch that the manifest names."""
    current = current_manifest(spark.read.parquet(manifest_path))
    return spark.read.parquet(chunk_path).join(
        current, ["book_id", "page_index", "digest", "batch_id"], "left_semi"
    )

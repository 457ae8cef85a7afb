"""Queries over the streaming operators, each run over files until no new one
is left (X1-X4)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as S

from pagework.catalog import outline as _outline
from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.plans.stage import shared_folder
from pagework.sources import derived as D
from pagework.sources import store
from pagework.streaming import streams as X

QUERIES = {}
ORACLE = {}


def replay(rows, order, files=3):
    """``rows`` as a stream of a few deliveries in the given order, with every
    seventh row delivered again and every eleventh one delivery late.  A value of
    ``order`` that most rows share is still written by many tasks, and the batches
    are as many for a large table as for a small one."""
    spark = rows.sparkSession
    # Which delivery a row belongs to: its place between the quantiles of ``order``.
    place = F.col(order).cast("double")
    cuts = rows.agg(F.percentile_approx(place, [i / files for i in range(1, files)], 1000)).first()[0] or []
    at = sum((F.coalesce((place > cut).cast("int"), F.lit(0)) for cut in cuts), F.lit(0))
    mark = F.pmod(F.xxhash64(*rows.columns), F.lit(77))
    at = F.when(mark % 11 == 0, at + 1).otherwise(at)
    dealt = rows.withColumn("_file", F.explode(F.when(mark % 7 == 0, F.array(at, at + 1)).otherwise(F.array(at))))
    ranged, path = store.new_folder(spark, "ranged"), store.new_folder(spark, "replay")
    dealt.write.partitionBy("_file").parquet(ranged)
    schema = S.StructType([*rows.schema, S.StructField("_file", S.IntegerType())])
    for i in range(files + 2):
        delivery = spark.read.schema(schema).parquet(ranged).where(F.col("_file") == i).drop("_file")
        delivery.write.mode("append").parquet(path)
    written = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    at_once = max(1, math.ceil(written / (files + 2)))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(path)


def folder(spark, label):
    shared_folder(spark)
    return store.new_folder(spark, label)


def folded(spark, stream, group, row, fold):
    """The result table of a stream whose batches are folded."""
    log, out = folder(spark, "log"), folder(spark, "folded")
    X.run_available(stream, "append", folder(spark, "checkpoint"),
                    lambda batch, _: X.fold_batch(batch, log, out, group, row, fold))
    return spark.read.parquet(out)


def x1_transcripts(spark, sf):
    return X.transcripts(D.speech(spark, sf)).select("session_id", F.md5("text").alias("digest"), "last_seq")


def x1_transcript_stream(spark, sf):
    done = folded(spark, replay(D.speech(spark, sf), "seq"), ["session_id"], ["seq"], X.transcripts)
    return done.select("session_id", F.md5("text").alias("digest"), "last_seq")


def deltas(spark, sf):
    """Answers cut into words; the last piece names the reason to stop."""
    a = D.turns(spark, sf).where("role = 'assistant'")
    words = F.split("content", "(?<= )")
    return a.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.posexplode(words).alias("seq", "delta"), F.size(words).alias("n"),
    ).select(
        "request_id", "seq", "delta",
        F.when(F.col("seq") == F.col("n") - 1,
               F.when(F.col("request_id") % 5 == 0, "length").otherwise("stop")).alias("finish"),
    )


def x2_join_deltas(spark, sf):
    return X.join_deltas(deltas(spark, sf)).select(
        "request_id", "failed", F.md5("text").alias("digest"))


def x2_delta_stream(spark, sf):
    done = folded(spark, replay(deltas(spark, sf), "seq"), ["request_id"], ["seq"], X.join_deltas)
    return done.select("request_id", "failed", F.md5("text").alias("digest"))


def x3_activity_stream(spark, sf):
    events = D.activity(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    done = folded(spark, replay(events, "ts"), ["user_id", "book_id"], ["event_id"], X.activity)
    return done.select(
        "user_id", "book_id", F.col("opened.event_id").alias("opened_event"),
        F.col("seen.page_index").alias("page_index"),
        F.array_join(F.transform("bookmarks", lambda p: p.cast("string")), ",").alias("bookmarks"))


def x4_index_stream(spark, sf):
    """All pages, then a second version of every tenth and an unchanged copy of
    every seventh one."""
    pages = D.pages(spark, sf).select("book_id", "page_index", "doc_id", "text")
    first = pages.withColumn("version", F.lit(1))
    changed = pages.where("doc_id % 10 = 0").withColumns(
        {"version": F.lit(2), "text": F.concat(F.lit("Changed. "), "text")})
    same = pages.where("doc_id % 7 = 0 AND doc_id % 10 <> 0").withColumn("version", F.lit(2))
    rows = first.unionByName(changed).unionByName(same).drop("doc_id")
    stream = replay(rows, "version")
    chunk_path, manifest_path = folder(spark, "chunks"), folder(spark, "manifest")
    X.run_available(stream, "append", folder(spark, "checkpoint"),
                    lambda batch, i: X.index_batch(batch, chunk_path, manifest_path, i))
    return X.current_chunks(spark, chunk_path, manifest_path).groupBy("book_id", "page_index").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


_DELTAS = """SELECT conv_id * 1000 + turn AS request_id, (conv_id * 1000 + turn) % 5 = 0 AS failed,
  md5(content) AS digest FROM rd_turns WHERE role = 'assistant'"""
ORACLE["x2_join_deltas"] = with_tables(_DELTAS)
ORACLE["x2_delta_stream"] = with_tables(_DELTAS)
ORACLE["x3_activity_stream"] = with_tables(
    """SELECT user_id, book_id, opened_event, a.page_index, coalesce(bookmarks, '') AS bookmarks FROM (
      SELECT user_id, book_id, max_by(event_id, (ts, event_id)) FILTER (WHERE action = 'open') AS opened_event,
        max_by(page_index, (ts, event_id)) FILTER (WHERE action IN ('open', 'navigate')) AS page_index
      FROM rd_activity GROUP BY ALL) a
    LEFT JOIN (SELECT user_id, book_id, string_agg(CAST(page_index AS VARCHAR), ',' ORDER BY page_index) AS bookmarks
      FROM (SELECT user_id, book_id, page_index FROM rd_activity WHERE action = 'toggle_bookmark' GROUP BY ALL
        HAVING count(*) % 2 = 1) GROUP BY ALL) m USING (user_id, book_id)"""
)
# Pieces in order, joined one by one: a recursive fold over each session's rows.
_JOIN = """CASE WHEN starts_with({b}, {a}) THEN {b} WHEN ends_with({a}, {b}) THEN {a} ELSE {a} ||
  CASE WHEN {n} = 0 AND regexp_matches(right({a}, 1), '[A-Za-z0-9$+<=>^`|~]') AND regexp_matches(left({b}, 1), '[A-Za-z0-9$+<=>^`|~]')
    THEN ' ' ELSE '' END || substr({b}, {n} + 1) END"""
_SHARED = "(SELECT coalesce(max(k), 0) FROM unnest(range(1, least(length({a}), length({b})) + 1)) AS u(k) WHERE right({a}, k) = left({b}, k))"


def _joined(a, b):
    return _JOIN.format(a=a, b=b, n=_SHARED.format(a=a, b=b))


_TRANSCRIPTS = with_tables(
    f"""SELECT s.session_id, md5(CASE WHEN v.said IS NULL THEN f.text ELSE {_joined("f.text", "v.said")} END) AS digest, s.last_seq
    FROM (SELECT session_id, max(seq) AS last_seq FROM rd_speech GROUP BY ALL) s
    JOIN (SELECT session_id, text FROM folded QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1) f USING (session_id)
    LEFT JOIN (SELECT h.session_id, h.said FROM heard h WHERE NOT is_final AND seq = (SELECT max(seq) FROM heard x
      WHERE x.session_id = h.session_id)) v USING (session_id)""",
    heard="SELECT session_id, seq, is_final, trim(text) AS said FROM rd_speech WHERE trim(text) <> ''",
    finals="SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM heard WHERE is_final",
    folded=f"""SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, '' AS text FROM rd_speech
      UNION ALL SELECT p.session_id, p.n + 1, {_joined("p.text", "f.said")} FROM folded p
      JOIN finals f ON f.session_id = p.session_id AND f.n = p.n + 1""",
)
_TRANSCRIPTS = _TRANSCRIPTS.replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["x1_transcripts"] = _TRANSCRIPTS
ORACLE["x1_transcript_stream"] = _TRANSCRIPTS
sql.define("version_pages", f"""
SELECT book_id, page_index, 0 AS seg_no, {_outline.chunk_text("CASE WHEN doc_id % 10 = 0 THEN 'Changed. ' || text ELSE text END")}
  AS text FROM rd_pages""")
sql.define("version_chunks", _outline.cut_sql("version_pages"))
ORACLE["x4_index_stream"] = with_tables(
    "SELECT book_id, page_index, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars "
    "FROM version_chunks GROUP BY ALL"
)

for _fn in (x1_transcripts, x1_transcript_stream, x2_join_deltas, x2_delta_stream, x3_activity_stream,
            x4_index_stream):
    QUERIES[_fn.__name__] = _fn

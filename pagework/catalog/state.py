"""Queries over keys, caches and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import outline as O
from pagework.operators import state as S
from pagework.sources import derived as D
from pagework.sources import store

QUERIES = {}
ORACLE = {}


def keyed(spark, sf):
    """Questions with the text of their focus page as context."""
    pages = D.pages(spark, sf).select("book_id", F.col("page_index").alias("focus_page"), "text")
    asks = D.queries(spark, sf).join(pages, ["book_id", "focus_page"])
    context = F.concat(F.lit("P"), (F.col("focus_page") + 1).cast("string"), F.lit("|"), "text")
    web = F.col("query_id") % 5 == 0
    key = S.answer_cache_key(
        F.col("query"), context, F.lit(""), provider=F.lit("local"), model=F.lit("m"),
        depth=F.col("depth"), web=web, whole_book=F.col("whole_book"),
    )
    return asks.select("query_id", "book_id", web.alias("web"), key.alias("cache_key"))


def d1_answer_cache(spark, sf):
    """Even questions were answered before."""
    asks = keyed(spark, sf)
    cache = asks.where("query_id % 2 = 0").select(
        "book_id", "cache_key", F.concat(F.lit("answer "), "query_id").alias("answer")
    )
    return S.probe_cache(asks, cache).select("query_id", "cache_key", "answer")


def d2_evict_cache(spark, sf):
    turns = D.turns(spark, sf).where("role = 'assistant'")
    newest = [F.desc("conv_id"), F.desc("turn")]
    small = S.evict_cache(turns, newest, 5).withColumn("keep", F.lit(5))
    full = S.evict_cache(turns, newest).withColumn("keep", F.lit(160))
    return small.unionByName(full).select("keep", "book_id", "conv_id", "turn")


def current_keys(spark, sf):
    prints = S.source_fingerprint(D.pages(spark, sf))
    signs = O.outline_signature(D.outline(spark, sf))
    return prints.join(signs, "book_id", "left").select(
        "book_id", "fingerprint", F.coalesce("signature", F.lit("")).alias("signature"),
        F.lit(2).alias("version"),
    )


def d3_stale_books(spark, sf):
    """The manifest has another text of every third book, another outline of
    every fourth, and an older version of every fifth."""
    now = current_keys(spark, sf)
    book = F.col("book_id")
    manifest = now.select(
        "book_id",
        F.when(book % 3 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(book % 4 == 0, "old").otherwise(F.col("signature")).alias("signature"),
        F.when(book % 5 == 0, 1).otherwise(F.col("version")).alias("version"),
    )
    return S.stale_books(now, manifest)


def d3_fingerprints(spark, sf):
    return current_keys(spark, sf).select("book_id", "fingerprint")


def d4_invalidate_derived(spark, sf):
    book = F.col("book_id")
    states = D.pages(spark, sf).select("book_id").distinct().select(
        "book_id",
        (book % 2 == 0).alias("has_outline"),
        F.when(book % 3 == 0, F.lit(True)).alias("manual_outline"),
        F.when(book % 5 > 0, (book % 3).cast("int")).alias("outline_version"),
        (book % 7 > 0).alias("has_summaries"),
        (book % 4).cast("int").alias("summary_version"),
    )
    return S.invalidate_derived(states, 2, 3)


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def d5_bookshelf(spark, sf):
    shelf = S.bookshelf(D.activity(spark, sf), 8)
    return shelf.withColumn("opened_at", stamp("opened_at"))


def d6_delete_books(spark, sf):
    gone = S.tombstones(D.activity(spark, sf))
    return S.delete_books(D.outline(spark, sf), gone).select("book_id", "ord")


def d7_bookmarks(spark, sf):
    return S.bookmarks_from_log(D.activity(spark, sf)).withColumn(
        "created_at", stamp("created_at")
    )


def d8_last_position(spark, sf):
    """Books of which the last ten pages are gone."""
    sizes = O.page_counts(D.pages(spark, sf)).withColumn("n_pages", F.col("n_pages") - 10)
    return S.last_position(D.activity(spark, sf), sizes)


def d9_opaque_book_id(spark, sf):
    return D.table(spark, sf, "pages").select(
        "page_id", S.opaque_book_id("url").alias("book_key"), S.public_book_id("url").alias("public")
    )


def d10_longest_prefix_root(spark, sf):
    """Hosts, and the first folder of every second host, as registered roots."""
    urls = D.table(spark, sf, "pages").select(F.col("url").alias("path")).distinct()
    parts = F.split("path", "/")
    hosts = urls.select(F.array_join(F.slice(parts, 1, 3), "/").alias("root"))
    folders = urls.where(F.length("path") % 2 == 0).select(
        F.array_join(F.slice(parts, 1, 4), "/").alias("root")
    )
    roots = hosts.unionByName(folders).distinct().select(
        "root", F.lit(False).alias("is_open"), F.length("root").alias("opened_at")
    )
    return S.longest_prefix_root(urls, roots)


def s6_write_read_state(spark, sf):
    """Bookmarks written as state by book, one book replaced, read back."""
    marks = S.bookmarks_from_log(D.activity(spark, sf)).drop("created_at")
    path = store.new_folder(spark, "state")
    store.write_state(marks, path)
    store.write_state(marks.where("book_id = 3 AND page_index < 25"), path)
    return store.read_state(spark, path, marks.schema)


ORACLE["d1_answer_cache"] = with_tables(
    f"""SELECT query_id, cache_key, CASE WHEN query_id % 2 = 0 AND query_id % 5 <> 0 THEN 'answer ' || query_id END
      AS answer
    FROM (SELECT q.query_id, sha256('v4' || chr(31) || 'local' || chr(31) || 'm' || chr(31) || depth || chr(31)
      || CASE WHEN query_id % 5 = 0 THEN 'true' ELSE 'false' END || chr(31)
      || CASE WHEN whole_book THEN 'true' ELSE 'false' END || chr(31) || {sql.inlined('query')} || chr(31)
      || 'P' || (focus_page + 1) || '|' || p.text || chr(31)) AS cache_key
      FROM rd_queries q JOIN rd_pages p ON p.book_id = q.book_id AND p.page_index = q.focus_page)"""
)
ORACLE["d2_evict_cache"] = with_tables(
    """SELECT k.keep, book_id, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY book_id
      ORDER BY conv_id DESC, turn DESC) AS r FROM rd_turns WHERE role = 'assistant')
    JOIN (VALUES (5), (160)) k(keep) ON r <= k.keep"""
)
ORACLE["d3_stale_books"] = with_tables(
    "SELECT DISTINCT book_id FROM rd_pages WHERE book_id % 3 = 0 OR book_id % 4 = 0 OR book_id % 5 = 0"
)
ORACLE["d3_fingerprints"] = with_tables(
    "SELECT book_id, sha256(string_agg(d, chr(30) ORDER BY b)) AS fingerprint FROM (SELECT book_id, page_index // 4096 AS b, "
    "sha256(string_agg(md5(text), chr(30) ORDER BY page_index)) AS d FROM rd_pages GROUP BY ALL) GROUP BY ALL"
)
ORACLE["d4_invalidate_derived"] = with_tables(
    """SELECT book_id, has_outline AND NOT gone AS has_outline, manual_outline,
      CASE WHEN gone THEN 2 ELSE outline_version END AS outline_version,
      has_summaries AND summary_version = 3 AS has_summaries, 3 AS summary_version
    FROM (SELECT *, has_outline AND manual_outline IS NULL AND outline_version IS DISTINCT FROM 2 AS gone FROM (
      SELECT DISTINCT book_id, book_id % 2 = 0 AS has_outline, CASE WHEN book_id % 3 = 0 THEN true END
        AS manual_outline, CASE WHEN book_id % 5 > 0 THEN CAST(book_id % 3 AS INT) END AS outline_version,
        book_id % 7 > 0 AS has_summaries, CAST(book_id % 4 AS INT) AS summary_version FROM rd_pages))"""
)
_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
ORACLE["d5_bookshelf"] = with_tables(
    f"""SELECT user_id, CAST(place AS INT) AS place, book_id, strftime(ts, {_STAMP}) AS opened_at FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM (
        SELECT user_id, book_id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id
        FROM rd_activity WHERE action = 'open' GROUP BY ALL)) WHERE place <= 8"""
)
sql.define("gone_books", """
SELECT book_id FROM rd_activity WHERE action IN ('open', 'delete') GROUP BY book_id
HAVING max_by(action, (ts, event_id)) = 'delete'""")
ORACLE["d6_delete_books"] = with_tables(
    "SELECT book_id, ord FROM rd_outline WHERE book_id NOT IN (SELECT book_id FROM gone_books)"
)
ORACLE["d7_bookmarks"] = with_tables(
    f"""SELECT user_id, book_id, page_index, strftime(max(ts), {_STAMP}) AS created_at FROM rd_activity
    WHERE action = 'toggle_bookmark' GROUP BY user_id, book_id, page_index HAVING count(*) % 2 = 1"""
)
ORACLE["d8_last_position"] = with_tables(
    """SELECT a.user_id, a.book_id, coalesce(least(a.page_index, greatest(s.n - 1, 0)), a.page_index) AS page_index
    FROM (SELECT user_id, book_id, max_by(page_index, (ts, event_id)) AS page_index FROM rd_activity
      WHERE action IN ('open', 'navigate') GROUP BY ALL) a
    LEFT JOIN (SELECT book_id, max(page_index) + 1 - 10 AS n FROM rd_pages GROUP BY ALL) s
      USING (book_id)"""
)
ORACLE["d9_opaque_book_id"] = (
    "SELECT page_id, sha256(url) AS book_key, left(sha256(url), 32) AS public FROM pages"
)
ORACLE["d10_longest_prefix_root"] = """
WITH urls AS (SELECT DISTINCT url AS path FROM pages),
roots AS (SELECT array_to_string(string_split(path, '/')[1:3], '/') AS root FROM urls
  UNION SELECT array_to_string(string_split(path, '/')[1:4], '/') FROM urls WHERE length(path) % 2 = 0)
SELECT path, arg_max(root, length(root)) AS root FROM urls JOIN roots
  ON path = root OR starts_with(path, root || '/') GROUP BY path"""
ORACLE["s6_write_read_state"] = with_tables(
    """SELECT user_id, book_id, page_index FROM rd_activity WHERE action = 'toggle_bookmark'
      AND (book_id <> 3 OR page_index < 25) GROUP BY ALL HAVING count(*) % 2 = 1"""
)

for _fn in (d1_answer_cache, d2_evict_cache, d3_stale_books, d3_fingerprints, d4_invalidate_derived,
            d5_bookshelf, d6_delete_books, d7_bookmarks, d8_last_position, d9_opaque_book_id,
            d10_longest_prefix_root, s6_write_read_state):
    QUERIES[_fn.__name__] = _fn

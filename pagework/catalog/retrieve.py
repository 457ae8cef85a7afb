"""Queries over retrieval (Q1-Q7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import outline as _outline  # noqa: F401  (defines the chunk tables)
from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import retrieve as Q
from pagework.plans import reading as R
from pagework.plans.stage import stage
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def index(spark, sf):
    return R.build_stored_index(D.pages(spark, sf), D.outline(spark, sf))


def q1_tfidf_retrieve(spark, sf):
    best = Q.retrieve(D.queries(spark, sf), index(spark, sf), 5, "tfidf")
    return best.select("query_id", "rank", "chunk_no", "page_index", "score")


def q2_bm25_retrieve(spark, sf):
    best = Q.retrieve(D.queries(spark, sf), index(spark, sf), 5)
    return best.select("query_id", "rank", "chunk_no", "page_index", "score")


def prepared(spark, sf):
    chunks = index(spark, sf)
    asks = Q.reading_budgets(D.queries(spark, sf))
    postings = Q.build_postings(asks, chunks)
    return chunks, asks, postings


def q3_focus_chunk(spark, sf):
    _, asks, postings = prepared(spark, sf)
    return Q.focus_chunk(asks, postings, Q.best_on_page(asks, postings)).select(
        "query_id", "chunk_no"
    )


def q4_scope_pool(spark, sf):
    """Pool names and sizes."""
    chunks, asks, postings = prepared(spark, sf)
    focus = Q.focus_chunk(asks, postings, Q.best_on_page(asks, postings))
    pools = stage(Q.scope_pools(asks, chunks, focus), "pools")
    sizes = Q.pool_members(pools, chunks, postings.lengths).groupBy("book_id", "pool_id").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_no").alias("first_no")
    )
    return pools.join(sizes, ["book_id", "pool_id"]).select("query_id", "n_chunks", "first_no")


def q5_expand_neighbours(spark, sf):
    """Whole-book seeds, so the SQL needs no scope."""
    chunks, asks, postings = prepared(spark, sf)
    pools = Q.whole_book_pools(asks)
    members = Q.whole_book_members(postings)
    seeds = stage(Q.rank_pool(postings, members, pools, 5, 5), "seeds")
    return Q.expand_neighbours(asks, seeds, pools, members).select(
        "query_id", "chunk_no", "page_index"
    )


def q6_reading_selection(spark, sf):
    return Q.retrieve_for_reading(D.queries(spark, sf), index(spark, sf)).select(
        "query_id", "chunk_no", "page_index"
    )


def q7_reading_budgets(spark, sf):
    return Q.reading_budgets(D.queries(spark, sf)).select(
        "query_id", "context_limit", "history_limit", "output_limit", "token_budget"
    )


_Q = "lower(" + sql.inlined("query") + ")"
_SQUEEZED = lambda x: rf"lower(regexp_replace({sql.normalized(x)}, '\s', '', 'g'))"

sql.define("chunk_tokens", f"""
SELECT book_id, chunk_no, token, count(*) AS tf FROM (
  SELECT book_id, chunk_no, unnest({sql.token_list('text')}) AS token FROM chunks) GROUP BY ALL""")
sql.define("chunk_lengths", """
SELECT c.book_id, c.chunk_no, c.page_index, c.path, c.title, coalesce(t.length, 0) AS length
FROM chunks c LEFT JOIN (SELECT book_id, chunk_no, sum(tf) AS length FROM chunk_tokens GROUP BY ALL) t
  USING (book_id, chunk_no)""")
sql.define("query_terms", f"""
SELECT query_id, book_id, token, count(*) AS qtf FROM (
  SELECT query_id, book_id, unnest({sql.token_list('query')}) AS token FROM rd_queries) GROUP BY ALL""")
sql.define("query_forms", f"SELECT query_id, book_id, {_Q} AS q FROM rd_queries")
sql.define("inline_chunks", f"""
SELECT book_id, chunk_no, page_index, path, title, lower({sql.inlined('text')}) AS t FROM chunks""")
sql.define("inline_titles", f"""
SELECT DISTINCT book_id, title, lower({sql.inlined('title')}) AS k FROM chunks WHERE title IS NOT NULL
UNION SELECT book_id, e, lower({sql.inlined('e')}) FROM (SELECT book_id, unnest(path) AS e FROM chunks)""")
sql.define("title_in_query", """
SELECT q.query_id, q.book_id, t.title FROM query_forms q JOIN inline_titles t
  ON t.book_id = q.book_id AND contains(q.q, t.k)""")
sql.define("bonuses", """
SELECT query_id, book_id, chunk_no, sum(b) AS bonus FROM (
  SELECT h.query_id, c.book_id, c.chunk_no, 5 AS b FROM chunks c JOIN title_in_query h
    ON h.book_id = c.book_id AND h.title = c.title
  UNION ALL SELECT h.query_id, c.book_id, c.chunk_no, 2 FROM (
    SELECT book_id, chunk_no, unnest(path) AS e FROM chunks) c JOIN title_in_query h
    ON h.book_id = c.book_id AND h.title = c.e
  UNION ALL SELECT q.query_id, c.book_id, c.chunk_no, 12 FROM query_forms q JOIN inline_chunks c
    ON c.book_id = q.book_id AND length(q.q) >= 8 AND contains(c.t, left(q.q, 160))) GROUP BY ALL""")


def bm25_sql(members: str) -> str:
    """Scores of (query_id, book_id, chunk_no) inside the pool of each query;
    ``members`` is (query_id, book_id, chunk_no, page_index, length)."""
    return f"""
SELECT query_id, book_id, chunk_no, page_index, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_index, chunk_no) AS rank
FROM (SELECT m.query_id, m.book_id, m.chunk_no, m.page_index,
    round(coalesce(s.score, 0) + coalesce(b.bonus, 0), 6) AS score
  FROM {members} m LEFT JOIN (
    SELECT p.query_id, p.chunk_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 *
      (0.25 + 0.75 * p.length / mean_length))) * least(1.6, 1 + ln(qtf))) AS score
    FROM (SELECT m.query_id, m.chunk_no, m.length, t.token, t.tf, q.qtf,
        count(*) OVER (PARTITION BY m.query_id, t.token) AS df
      FROM {members} m JOIN chunk_tokens t USING (book_id, chunk_no)
      JOIN query_terms q ON q.query_id = m.query_id AND q.token = t.token) p
    JOIN (SELECT query_id, count(*) AS n, greatest(avg(length), 1) AS mean_length FROM {members}
      GROUP BY ALL) USING (query_id) GROUP BY ALL) s USING (query_id, chunk_no)
  LEFT JOIN bonuses b ON b.query_id = m.query_id AND b.chunk_no = m.chunk_no)
WHERE score > 0"""


sql.define("book_pool", """
SELECT q.query_id, l.book_id, l.chunk_no, l.page_index, l.length
FROM rd_queries q JOIN chunk_lengths l USING (book_id)""")
sql.define("book_ranks", bm25_sql("book_pool"))
sql.define("page_pool", """
SELECT q.query_id, l.book_id, l.chunk_no, l.page_index, l.length
FROM rd_queries q JOIN chunk_lengths l ON l.book_id = q.book_id AND l.page_index = q.focus_page""")
sql.define("page_ranks", bm25_sql("page_pool"))
sql.define("focus", """
SELECT q.query_id, q.book_id, coalesce(r.chunk_no, (SELECT min(chunk_no) FROM chunk_lengths l
    WHERE l.book_id = q.book_id AND l.page_index = q.focus_page),
  (SELECT max(chunk_no) FROM chunk_lengths l WHERE l.book_id = q.book_id
    AND l.page_index <= q.focus_page)) AS chunk_no
FROM rd_queries q LEFT JOIN page_ranks r ON r.query_id = q.query_id AND r.rank = 1""")
sql.define("scopes", """
SELECT query_id, book_id, CASE WHEN whole_book OR coalesce(len(path), 0) = 0 THEN NULL
  WHEN inner_path OR len(path) = 1 THEN path ELSE path[1:len(path) - 1] END AS scope_path,
  whole_book, focus_page FROM (
  SELECT q.*, c.path, EXISTS (SELECT 1 FROM chunks x WHERE x.book_id = q.book_id
    AND len(x.path) > len(c.path) AND x.path[1:len(c.path)] = c.path) AS inner_path
  FROM rd_queries q JOIN focus f USING (query_id)
  LEFT JOIN chunks c ON c.book_id = q.book_id AND c.chunk_no = f.chunk_no)""")
sql.define("scope_members", """
SELECT s.query_id, l.book_id, l.chunk_no, l.page_index, l.length
FROM scopes s JOIN chunk_lengths l ON l.book_id = s.book_id AND (s.whole_book
  OR (s.scope_path IS NOT NULL AND l.path[1:len(s.scope_path)] = s.scope_path)
  OR (NOT s.whole_book AND s.scope_path IS NULL AND abs(l.page_index - s.focus_page) <= 3))""")
sql.define("scope_ranks", bm25_sql("scope_members"))
sql.define("budgets", """
SELECT query_id, book_id, focus_page, whole_book, scope, context_limit, history_limit, output_limit,
  CAST(CASE WHEN whole_book THEN floor(base * 112 / 100) ELSE base END AS INT) AS token_budget,
  CASE scope WHEN 'explanation' THEN CASE WHEN whole_book THEN 4 ELSE 3 END
    WHEN 'standard' THEN CASE WHEN whole_book THEN 7 ELSE 5 END
    ELSE CASE WHEN whole_book THEN 10 ELSE 7 END END AS seed_limit,
  CASE scope WHEN 'explanation' THEN 0 WHEN 'standard' THEN 1 ELSE 2 END AS radius,
  greatest(1, least(context_limit, CASE scope
    WHEN 'explanation' THEN CASE WHEN whole_book THEN 6 ELSE 4 END
    WHEN 'standard' THEN CASE WHEN whole_book THEN 10 ELSE 6 END
    ELSE CASE WHEN whole_book THEN 14 ELSE 9 END END)) AS cap
FROM (SELECT *, CASE depth WHEN 'economical' THEN 6 WHEN 'balanced' THEN 9 ELSE 14 END AS context_limit,
    CASE depth WHEN 'economical' THEN 4 WHEN 'balanced' THEN 8 ELSE 12 END AS history_limit,
    CASE depth WHEN 'economical' THEN 1500 WHEN 'balanced' THEN 3000 ELSE 5000 END AS output_limit,
    CASE depth || '/' || scope WHEN 'economical/explanation' THEN 3200 WHEN 'economical/standard' THEN 5000
      WHEN 'economical/context' THEN 6500 WHEN 'balanced/explanation' THEN 4800
      WHEN 'balanced/standard' THEN 7200 WHEN 'balanced/context' THEN 9600
      WHEN 'deep/explanation' THEN 6500 WHEN 'deep/standard' THEN 10000 ELSE 14000 END AS base
  FROM rd_queries)""")
sql.define("reading_choice", """
SELECT query_id, book_id, chunk_no, page_index FROM (
  SELECT s.query_id, s.book_id, s.chunk_no, s.page_index, b.cap, row_number() OVER (
    PARTITION BY s.query_id ORDER BY CASE WHEN p.chunk_no IS NOT NULL THEN 0 ELSE coalesce(r.rank, 99) END,
    abs(s.page_index - b.focus_page), s.chunk_no) AS place
  FROM (SELECT DISTINCT m.query_id, m.book_id, m.chunk_no, m.page_index
    FROM scope_members m JOIN budgets b USING (query_id)
    LEFT JOIN scope_ranks r ON r.query_id = m.query_id AND r.rank <= b.seed_limit
      AND abs(r.chunk_no - m.chunk_no) <= b.radius
    WHERE r.chunk_no IS NOT NULL OR abs(m.page_index - b.focus_page) <= b.radius) s
  JOIN budgets b USING (query_id)
  LEFT JOIN scope_ranks r ON r.query_id = s.query_id AND r.chunk_no = s.chunk_no AND r.rank <= b.seed_limit
  LEFT JOIN page_ranks p ON p.query_id = s.query_id AND p.rank = 1 AND p.chunk_no = s.chunk_no)
WHERE place <= cap""")

ORACLE["q1_tfidf_retrieve"] = with_tables(
    f"""SELECT query_id, CAST(rank AS INT) AS rank, chunk_no, page_index, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_index, chunk_no) AS rank
      FROM (SELECT query_id, chunk_no, page_index, round(sum(s), 6) AS score FROM (
        SELECT p.query_id, p.chunk_no, p.page_index, ln(1 + (n + 0.5) / (df + 0.5)) * least(3, tf)
          * least(1.6, 1 + ln(qtf)) AS s
        FROM (SELECT q.query_id, q.qtf, t.*, count(*) OVER (PARTITION BY q.query_id, t.token) AS df
          FROM tq q JOIN tc t USING (book_id, token)) p
        JOIN (SELECT book_id, count(*) AS n FROM chunks GROUP BY ALL) USING (book_id)
        UNION ALL SELECT DISTINCT q.query_id, c.chunk_no, c.page_index, 7 FROM sq q JOIN (
          SELECT book_id, chunk_no, page_index, unnest(path) AS e FROM chunks) c
          ON c.book_id = q.book_id AND contains(q.q, {_SQUEEZED('c.e')})
        UNION ALL SELECT q.query_id, c.chunk_no, c.page_index, 12 FROM sq q JOIN sc c
          ON c.book_id = q.book_id AND length(q.q) >= 8 AND contains(c.t, left(q.q, 160)))
      GROUP BY ALL) WHERE score > 0) WHERE rank <= 5""",
    tq=f"""SELECT query_id, book_id, token, count(*) AS qtf FROM (SELECT query_id, book_id,
      unnest(regexp_extract_all(lower({sql.normalized('query')}), '[a-z0-9_]+')) AS token FROM rd_queries)
      GROUP BY ALL""",
    tc=f"""SELECT book_id, chunk_no, page_index, token, count(*) AS tf FROM (SELECT book_id, chunk_no,
      page_index, unnest(regexp_extract_all(lower({sql.normalized('text')}), '[a-z0-9_]+')) AS token
      FROM chunks) GROUP BY ALL""",
    sq=f"SELECT query_id, book_id, {_SQUEEZED('query')} AS q FROM rd_queries",
    sc=f"SELECT book_id, chunk_no, page_index, {_SQUEEZED('text')} AS t FROM chunks",
)
ORACLE["q2_bm25_retrieve"] = with_tables(
    "SELECT query_id, CAST(rank AS INT) AS rank, chunk_no, page_index, score FROM book_ranks "
    "WHERE rank <= 5"
)
ORACLE["q3_focus_chunk"] = with_tables("SELECT query_id, chunk_no FROM focus")
ORACLE["q4_scope_pool"] = with_tables(
    "SELECT query_id, count(*) AS n_chunks, min(chunk_no) AS first_no FROM scope_members GROUP BY ALL"
)
ORACLE["q5_expand_neighbours"] = with_tables(
    """SELECT DISTINCT m.query_id, m.chunk_no, m.page_index FROM book_pool m JOIN budgets b USING (query_id)
    LEFT JOIN book_ranks r ON r.query_id = m.query_id AND r.rank <= 5
      AND abs(r.chunk_no - m.chunk_no) <= b.radius
    WHERE r.chunk_no IS NOT NULL OR abs(m.page_index - b.focus_page) <= b.radius"""
)
ORACLE["q6_reading_selection"] = with_tables(
    "SELECT query_id, chunk_no, page_index FROM reading_choice"
)
ORACLE["q7_reading_budgets"] = with_tables(
    "SELECT query_id, context_limit, history_limit, output_limit, token_budget FROM budgets"
)

for _fn in (q1_tfidf_retrieve, q2_bm25_retrieve, q3_focus_chunk, q4_scope_pool,
            q5_expand_neighbours, q6_reading_selection, q7_reading_budgets):
    QUERIES[_fn.__name__] = _fn

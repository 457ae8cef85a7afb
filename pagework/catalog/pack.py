"""Queries over context packing (P1-P4) and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import retrieve as CQ
from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import outline as O
from pagework.operators import pack as P
from pagework.operators import retrieve as Q
from pagework.plans import reading as R
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def p1_trim_overlap(spark, sf):
    chunks = CQ.index(spark, sf)
    return P.trim_overlap(chunks, ["book_id"]).select(
        "book_id", "chunk_no", F.length("text").alias("n"), F.md5("text").alias("digest")
    )


def reading_context(spark, sf):
    """Flagship: index the books, retrieve for every question in its scope,
    expand, cap, trim overlaps and pack to the token budget."""
    return R.reading_context(D.pages(spark, sf), D.outline(spark, sf), D.queries(spark, sf)).select(
        "query_id", "position", "chunk_no", "page_index", "tokens", F.md5("text").alias("digest")
    )


def p3_assemble_prompt(spark, sf):
    """Every second question comes with its phrase as the selected passage."""
    outline, queries = D.outline(spark, sf), D.queries(spark, sf)
    excerpts = R.reading_context(D.pages(spark, sf), outline, queries)
    asks = queries.select(
        "query_id", "book_id", "whole_book", "focus_page",
        F.when(F.col("query_id") % 2 == 0, F.col("phrase")).alias("passage"),
        F.col("query").alias("request"),
    )
    return P.assemble_prompt(asks, excerpts, outline, outline_lines=180).select(
        "query_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest")
    )


def p4_even_sample(spark, sf):
    pages = D.pages(spark, sf)
    chunks = CQ.index(spark, sf)
    header = F.length(F.concat(F.lit("[P"), (F.col("page_index") + 1).cast("string"), F.lit("]\n")))
    sized = chunks.withColumn("size", F.length("text") + header + 2)
    spans = O.count_in_spans(
        O.chapter_spans(D.outline(spark, sf), O.page_counts(pages)), sized, F.col("size")
    )
    return P.even_sample(spans, sized, 12_000)


sql.define("trimmed_chunks", f"""
SELECT *, CASE WHEN overlap IS NULL THEN text ELSE {sql.stripped('substr(text, overlap + 1)')} END AS cut
FROM (SELECT *, list_filter(range(least(260, length(before), length(text)), 23, -1),
    lambda n: right(before, n) = left(text, n))[1] AS overlap
  FROM (SELECT *, lag(text) OVER (PARTITION BY book_id, page_index, path ORDER BY chunk_no) AS before
    FROM chunks))""")
sql.define("chosen_chunks", """
SELECT r.query_id, r.chunk_no, r.page_index, c.title, c.path, c.text, lag(c.text) OVER (
  PARTITION BY r.query_id, r.page_index, c.path ORDER BY r.chunk_no) AS before
FROM reading_choice r JOIN chunks c USING (book_id, chunk_no)""")
sql.define("pack_items", f"""
SELECT query_id, chunk_no, page_index, title, text, row_number() OVER (PARTITION BY query_id
  ORDER BY chunk_no) AS pos, 12 + CASE WHEN title IS NULL THEN 0 ELSE {sql.token_estimate('title')} END
  AS cost, {sql.token_estimate('text')} AS tokens
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower({sql.inlined('text')})
    ORDER BY chunk_no) AS copy FROM (
  SELECT query_id, chunk_no, page_index, title, CASE WHEN overlap IS NULL THEN text
    ELSE {sql.stripped('substr(text, overlap + 1)')} END AS text FROM (
    SELECT *, list_filter(range(least(260, length(before), length(text)), 23, -1),
      lambda n: right(before, n) = left(text, n))[1] AS overlap FROM chosen_chunks))
  WHERE {sql.inlined('text')} <> '') WHERE copy = 1""")
_CUT = "left(i.text, greatest(80, CAST(floor(length(i.text) * (s.remaining - i.cost) / i.tokens) AS INT)))"
sql.define("packed", f"""
WITH RECURSIVE steps(query_id, pos, remaining, text, tokens, chunk_no, page_index, title) AS (
  SELECT query_id, CAST(0 AS BIGINT), token_budget, '', 0, CAST(NULL AS BIGINT), CAST(NULL AS INT),
    CAST(NULL AS VARCHAR) FROM budgets
  UNION ALL
  SELECT query_id, pos, remaining - tokens, text, tokens, chunk_no, page_index, title FROM (
    SELECT query_id, pos, remaining, text, {sql.token_estimate('text')} AS tokens, chunk_no, page_index,
      title FROM (
      SELECT s.query_id, i.pos, s.remaining - i.cost AS remaining, i.chunk_no, i.page_index, i.title,
        CASE WHEN i.tokens > s.remaining - i.cost THEN {_CUT} ELSE i.text END AS text
      FROM steps s JOIN pack_items i ON i.query_id = s.query_id AND i.pos = s.pos + 1
      WHERE s.remaining - i.cost >= 80)))
SELECT query_id, CAST(pos - 1 AS INT) AS position, chunk_no, page_index, title, text, tokens
FROM steps WHERE pos > 0""")
sql.define("outline_maps", """
SELECT book_id, string_agg(repeat('  ', least(level, 5)) || '- P' || (page_index + 1) || ' ' || title,
  chr(10) ORDER BY ord) AS outline_map FROM rd_outline WHERE ord < 180 GROUP BY ALL""")

ORACLE["p1_trim_overlap"] = with_tables(
    "SELECT book_id, chunk_no, CAST(length(cut) AS INT) AS n, md5(cut) AS digest FROM trimmed_chunks"
)
ORACLE["reading_context"] = with_tables(
    "SELECT query_id, position, chunk_no, page_index, tokens, md5(text) AS digest FROM packed"
)
ORACLE["p3_assemble_prompt"] = with_tables(
    """SELECT query_id, CAST(length(prompt) AS INT) AS n, md5(prompt) AS digest FROM (
    SELECT q.query_id, CASE WHEN q.whole_book THEN 'Outline:' || chr(10) || m.outline_map || chr(10) || chr(10)
        ELSE '' END
      || CASE WHEN q.query_id % 2 = 0 AND NOT coalesce(e.marked, false) THEN 'Passage [P' || (q.focus_page + 1)
        || ']:' || chr(10) || q.phrase || chr(10) || chr(10) ELSE '' END
      || 'Excerpts:' || chr(10) || coalesce(e.excerpts, '') || chr(10) || chr(10) || q.query AS prompt
    FROM rd_queries q JOIN outline_maps m USING (book_id) LEFT JOIN (
      SELECT query_id, bool_or(first IS NOT NULL) AS marked, string_agg(coalesce('## ' || title || chr(10), '')
        || '[P' || (page_index + 1) || ']' || chr(10) || CASE WHEN position = first THEN
          left(text, place - 1) || '⟦' || phrase || '⟧' || substr(text, place + length(phrase)) ELSE text END,
        chr(10) || chr(10) ORDER BY position) AS excerpts
      FROM (SELECT *, min(CASE WHEN place > 0 THEN position END) OVER (PARTITION BY query_id) AS first
        FROM (SELECT p.*, q.phrase, CASE WHEN p.query_id % 2 = 0 AND q.phrase <> '' THEN
            strpos(lower(p.text), lower(q.phrase)) ELSE 0 END AS place
          FROM packed p JOIN rd_queries q USING (query_id))) GROUP BY query_id) e USING (query_id))"""
)
ORACLE["p4_even_sample"] = with_tables(
    """SELECT book_id, ord, chunk_no FROM (
      SELECT book_id, ord, unnest(CASE WHEN total <= 12000 THEN nos ELSE
        (SELECT CASE WHEN len(x.out) > 0 THEN x.out ELSE [nos[1]] END FROM (SELECT list_reduce(
          list_prepend({'used': CAST(0 AS BIGINT), 'out': CAST([] AS BIGINT[])},
            list_transform(picks, lambda i: {'used': sizes[i + 1], 'out': [nos[i + 1]]})),
          lambda a, b: CASE WHEN a.used + b.used > 12000 THEN a
            ELSE {'used': a.used + b.used, 'out': list_concat(a.out, b.out)} END) AS x)) END) AS chunk_no
      FROM (SELECT *, list_concat([0, n - 1], list_filter(list_transform(range(1, CAST(greatest(m - 1, 1) AS BIGINT)),
            lambda p: CAST(floor(p * (n - 1) / (m - 1) + 0.5) AS BIGINT)),
          lambda i: i <> 0 AND i <> n - 1)) AS picks
        FROM (SELECT *, greatest(2, least(n, floor(12000 / greatest(1, floor(total / n))))) AS m
          FROM (SELECT s.book_id, s.ord, count(*) AS n, CAST(sum(c.size) AS BIGINT) AS total,
              list(c.chunk_no ORDER BY c.chunk_no) AS nos,
              list(CAST(c.size AS BIGINT) ORDER BY c.chunk_no) AS sizes
            FROM spans s JOIN (SELECT *, length(text) + length('[P' || (page_index + 1) || ']' || chr(10)) + 2
                AS size FROM chunks) c ON c.book_id = s.book_id AND c.page_index >= s.page_index
              AND c.page_index < s.end_page GROUP BY ALL))))"""
)

for _fn in (p1_trim_overlap, reading_context, p3_assemble_prompt, p4_even_sample):
    QUERIES[_fn.__name__] = _fn
QUERIES["p2_pack_context"] = lambda spark, sf: R.reading_context(
    D.pages(spark, sf), D.outline(spark, sf), D.queries(spark, sf)
).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
ORACLE["p2_pack_context"] = with_tables(
    "SELECT query_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM packed GROUP BY ALL"
)

"""Queries over full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import retrieve as CQ
from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import search as S
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def asked(spark, sf):
    """Every outline entry asks its book for the first two words of its title."""
    o = D.outline(spark, sf)
    return o.select(
        (F.col("book_id") * 1000 + F.col("ord")).alias("query_id"),
        "book_id",
        F.array_join(F.slice(F.split("title", " "), 1, 2), " ").alias("phrase"),
    )


def f1_match_ranges(spark, sf):
    return S.match_ranges(asked(spark, sf), D.lines(spark, sf))


def f2_sentence_hits(spark, sf):
    return S.sentence_hits(asked(spark, sf), D.pages(spark, sf), limit=500).select(
        "query_id", "page_index", "sentence_no", F.md5("sentence").alias("digest")
    )


def f3_snippet(spark, sf):
    lines = D.lines(spark, sf).withColumnRenamed("line", "text")
    key = ["page_index", "line_no"]
    return S.snippets(asked(spark, sf), lines, key).select("query_id", *key, "snippet")


def every_second_broken(queries):
    """Odd questions ask for a phrase that cannot occur."""
    odd = F.concat("phrase", F.lit(" zzqx"))
    return queries.withColumn(
        "phrase", F.when(F.col("query_id") % 2 == 1, odd).otherwise(F.col("phrase"))
    )


def f4_fulltext_search(spark, sf):
    asks = every_second_broken(asked(spark, sf))
    return S.fulltext_search(asks, D.pages(spark, sf), CQ.index(spark, sf)).select(
        "query_id", "page_index", "snippet"
    )


_GAP = "[^\\p{L}\\p{N}]*"
_PATTERN = f"array_to_string(string_split(needle, ''), '{_GAP}')"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def ranges(text: str) -> str:
    """List of (piece length, match length) pairs of the folded text."""
    return (f"list_zip(list_transform(regexp_split_to_array({text}, pattern), lambda p: length(p)), "
            f"list_transform(regexp_extract_all({text}, pattern), lambda m: length(m)))")


sql.define("search_asks", """
SELECT book_id * 1000 + ord AS query_id, book_id,
  array_to_string(string_split(title, ' ')[1:2], ' ') AS phrase FROM rd_outline""")
sql.define("phrases", f"""
SELECT *, {_PATTERN} AS pattern FROM (SELECT query_id, book_id, {sql.projection('phrase')} AS needle
FROM search_asks) WHERE needle <> ''""")
sql.define("line_forms", f"""
SELECT *, {sql.projection('line')} AS projected FROM rd_lines""")
sql.define("line_hits", f"""
SELECT *, {fold('line')} AS folded FROM (
  SELECT q.query_id, q.book_id, q.pattern, l.page_index, l.line_no, l.line
  FROM phrases q JOIN line_forms l ON l.book_id = q.book_id AND contains(l.projected, q.needle))""")
ORACLE["f1_match_ranges"] = with_tables(
    """SELECT query_id, book_id, page_index, line_no, CAST(sum(p) OVER w + coalesce(sum(m) OVER e, 0) AS INT)
      AS start, CAST(sum(p) OVER w + sum(m) OVER w AS INT) AS stop
    FROM (SELECT query_id, book_id, page_index, line_no, i, ps[i] AS p, ms[i] AS m FROM (
      SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT query_id, book_id, page_index, line_no,
          list_transform(regexp_split_to_array(folded, pattern), lambda p: length(p)) AS ps,
          list_transform(regexp_extract_all(folded, pattern), lambda m: length(m)) AS ms FROM line_hits)))
    WINDOW w AS (PARTITION BY query_id, page_index, line_no ORDER BY i),
      e AS (PARTITION BY query_id, page_index, line_no ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
ORACLE["f2_sentence_hits"] = with_tables(
    f"""SELECT query_id, page_index, sentence_no, md5(s) AS digest FROM (
      SELECT q.query_id, s.page_index, s.sentence_no, s.s, row_number() OVER (PARTITION BY q.query_id
        ORDER BY s.page_index, s.sentence_no) AS r
      FROM phrases q JOIN parts s ON s.book_id = q.book_id AND s.s <> ''
        AND contains({sql.projection('s.s')}, q.needle)) WHERE r <= 500""",
    parts=rf"""SELECT book_id, page_index, CAST(i - 1 AS INT) AS sentence_no, p[i] AS s FROM (
      SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT book_id, page_index,
        string_split(regexp_replace({sql.normalized('text')}, '([。！？.!?])\s*', '\1' || chr(1), 'g'), chr(1))
        AS p FROM rd_pages))""",
)


def display(x: str) -> str:
    return sql.stripped(rf"regexp_replace({sql.despaced(x)}, '\s+', ' ', 'g')")


def snippet_sql(rows: str, columns: str) -> str:
    """First match of ``pattern`` in the display form of ``text``, widened."""
    return rf"""
SELECT {columns}, {sql.stripped("substr(shown, opening + 1, stop + length(closing) - opening)")} AS snippet
FROM (SELECT *, length(regexp_extract(left(shown, start), '(?s)^.*[.。!?！？；;]')) AS opening,
    regexp_extract(substr(shown, stop + 1), '(?s)^[^.。!?！？；;]*[.。!?！？；;]?') AS closing
  FROM (SELECT *, length(regexp_split_to_array({fold('shown')}, pattern)[1]) AS start,
      length(regexp_split_to_array({fold('shown')}, pattern)[1])
        + length(regexp_extract({fold('shown')}, pattern)) AS stop
    FROM (SELECT *, {display('text')} AS shown FROM {rows})
    WHERE regexp_matches({fold('shown')}, pattern)))"""


ORACLE["f3_snippet"] = with_tables(
    snippet_sql("hits", "query_id, page_index, line_no"),
    hits="SELECT *, line AS text FROM line_hits",
)
sql.define("chunk_df", "SELECT book_id, token, count(*) AS df FROM chunk_tokens GROUP BY ALL")
ORACLE["f4_fulltext_search"] = with_tables(
    f"""SELECT query_id, page_index, min(snippet) AS snippet FROM (
      SELECT * FROM direct UNION ALL
      SELECT query_id, page_index, {sql.inlined('text')} FROM (
        SELECT s.query_id, page_index, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
          page_index, chunk_no) AS r
        FROM (SELECT query_id, book_id, chunk_no, round(sum(part), 6) AS score FROM (
            SELECT query_id, book_id, chunk_no, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 *
              (0.25 + 0.75 * length / mean_length))) * least(1.6, 1 + ln(qtf)) AS part
            FROM terms JOIN chunk_tokens USING (book_id, token) JOIN chunk_df USING (book_id, token)
            JOIN chunk_lengths USING (book_id, chunk_no)
            JOIN (SELECT book_id, count(*) AS n, greatest(1, avg(length)) AS mean_length FROM chunk_lengths
              GROUP BY ALL) USING (book_id)
            UNION ALL SELECT q.query_id, c.book_id, c.chunk_no, c.w FROM silent q JOIN (
              SELECT book_id, chunk_no, title AS e, 5 AS w FROM chunks WHERE title IS NOT NULL
              UNION ALL SELECT book_id, chunk_no, unnest(path), 2 FROM chunks) c
              ON c.book_id = q.book_id AND contains(q.q, lower({sql.inlined('c.e')}))
            UNION ALL SELECT q.query_id, c.book_id, c.chunk_no, 12 FROM silent q JOIN inline_chunks c
              ON c.book_id = q.book_id AND length(q.q) >= 8 AND contains(c.t, left(q.q, 160)))
          GROUP BY ALL) s JOIN chunks USING (book_id, chunk_no) WHERE score > 0) WHERE r <= 30)
    GROUP BY query_id, page_index, lower({sql.inlined('snippet')})""",
    asks="""SELECT * REPLACE (CASE WHEN query_id % 2 = 1 THEN phrase || ' zzqx' ELSE phrase END AS phrase)
      FROM search_asks""",
    wanted=f"""SELECT *, {_PATTERN} AS pattern FROM (SELECT query_id, book_id, {sql.projection('phrase')}
      AS needle FROM asks) WHERE needle <> ''""",
    page_forms=f"SELECT *, {sql.projection('text')} AS projected FROM rd_pages",
    page_hits=f"""SELECT q.query_id, q.pattern, p.page_index, p.text FROM wanted q JOIN page_forms p
      ON p.book_id = q.book_id AND contains(p.projected, q.needle)""",
    direct=snippet_sql("page_hits", "query_id, page_index"),
    silent=f"""SELECT query_id, book_id, lower({sql.inlined('phrase')}) AS q FROM asks
      WHERE query_id NOT IN (SELECT query_id FROM direct)""",
    terms=f"""SELECT query_id, book_id, token, count(*) AS qtf FROM (SELECT query_id, book_id,
      unnest({sql.token_list('phrase')}) AS token FROM asks WHERE query_id NOT IN
        (SELECT query_id FROM direct)) GROUP BY ALL""",
)

for _fn in (f1_match_ranges, f2_sentence_hits, f3_snippet, f4_fulltext_search):
    QUERIES[_fn.__name__] = _fn

"""Queries over page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import pages as P
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def ocr_side(spark, sf):
    """Recognised page text: the words of the page joined again, in order."""
    words = D.words(spark, sf, copies=False)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "word_no", "text")))
    return words.groupBy("book_id", "page_index").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text")
    )


def s1_choose_page_text(spark, sf):
    """Every fifth page lost most of its embedded text."""
    embedded = D.pages(spark, sf).select(
        "book_id",
        "page_index",
        F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 10))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    chosen = P.choose_page_text(embedded, ocr_side(spark, sf))
    return chosen.select(
        "book_id", "page_index", "came_from_ocr", F.md5("text").alias("digest")
    )


ORACLE["s1_choose_page_text"] = with_tables(
    r"""SELECT book_id, page_index, coalesce(short AND o.n >= length(regexp_replace(e.text, '\s', '', 'g')), false) AS came_from_ocr,
      md5(CASE WHEN short AND o.n >= length(regexp_replace(e.text, '\s', '', 'g')) THEN o.text ELSE e.text END) AS digest
    FROM (SELECT *, length(regexp_replace(text, '\s', '', 'g')) < 24 AS short FROM (
        SELECT book_id, page_index, CASE WHEN doc_id % 5 = 0 THEN left(text, 10) ELSE text END AS text
        FROM rd_pages)) e
    LEFT JOIN (SELECT book_id, page_index, text, length(regexp_replace(text, '\s', '', 'g')) AS n
      FROM (SELECT book_id, page_index, string_agg(text, ' ' ORDER BY line_no, word_no) AS text
            FROM rd_words WHERE dup = 0 GROUP BY ALL)) o USING (book_id, page_index)"""
)


def s4_merge_refreshed_pages(spark, sf):
    """Every third page was read again, half of those without a label, and the
    pages of each tenth document are new."""
    old = D.pages(spark, sf).where("doc_id % 10 <> 7")
    new = D.pages(spark, sf).where("doc_id % 3 = 0 OR doc_id % 10 = 7").select(
        "book_id",
        "page_index",
        F.concat(F.lit("new "), "text").alias("text"),
        F.lit(True).alias("came_from_ocr"),
        F.when(F.col("doc_id") % 2 == 0, F.col("page_label")).alias("page_label"),
    )
    merged = P.merge_refreshed_pages(old, new)
    return merged.select(
        "book_id", "page_index", "came_from_ocr", "page_label", F.md5("text").alias("digest")
    )


ORACLE["s4_merge_refreshed_pages"] = with_tables(
    """SELECT book_id, page_index, CASE WHEN fresh THEN true ELSE came_from_ocr END AS came_from_ocr,
      CASE WHEN doc_id % 10 = 7 AND doc_id % 2 = 1 THEN NULL ELSE page_label END AS page_label,
      md5(CASE WHEN fresh THEN 'new ' || text ELSE text END) AS digest
    FROM (SELECT *, doc_id % 3 = 0 OR doc_id % 10 = 7 AS fresh FROM rd_pages)"""
)


def s5_render_markdown(spark, sf):
    pages = D.pages(spark, sf)
    titles = pages.where("page_index = 0").select(
        "book_id", F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("title")
    )
    blocks = P.render_book_markdown(pages, D.outline(spark, sf), titles)
    return blocks.select("book_id", "position", F.md5("block").alias("digest"))


ORACLE["s5_render_markdown"] = with_tables(
    """SELECT book_id, -1 AS position, md5('# Book ' || book_id || chr(10)) AS digest
    FROM rd_pages WHERE page_index = 0
    UNION ALL
    SELECT p.book_id, p.page_index, md5(coalesce(h.heads, '') || '<!-- P' || (p.page_index + 1) || ' -->'
      || chr(10) || p.text || chr(10))
    FROM rd_pages p LEFT JOIN (SELECT book_id, page_index, string_agg(repeat('#', least(6, greatest(2,
      level + 2))) || ' ' || title || chr(10) || chr(10), '' ORDER BY ord) AS heads
      FROM rd_outline GROUP BY ALL) h USING (book_id, page_index) WHERE p.text <> ''"""
)


def c1_repeated_edge_lines(spark, sf):
    return P.repeated_edge_lines(D.pages(spark, sf))


def c2_compact_pages(spark, sf):
    cleaned = P.drop_repeated_edges(D.pages(spark, sf))
    return cleaned.select(
        "book_id",
        "page_index",
        F.md5("text").alias("digest_lines"),
        F.md5(P.compact_text("text")).alias("digest"),
    )


def edge_key(x: str) -> str:
    """Word boundaries in any script: separators are doubled so each token owns
    one on both sides, tokens are replaced, doubles are undone."""
    t = rf"regexp_replace(lower({x}), '\s+', ' ', 'g')"
    t = rf"regexp_replace({t}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    t = (rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])[ivxlcdm0-9]+($|[^\p{{L}}\p{{N}}_])', "
         rf"'\1' || chr(1) || '\2', 'g')")
    t = rf"regexp_replace({t}, '([^\p{{L}}\p{{N}}_\x01])[^\p{{L}}\p{{N}}_\x01]', '\1', 'g')"
    return sql.stripped(f"replace({t}, chr(1), '#')")


sql.define("edge_lines", f"""
SELECT book_id, page_index, line_no, line, {edge_key('line')} AS edge_key FROM rd_lines""")
sql.define("edge_repeats", """
SELECT book_id, edge_key, count(*) AS n FROM (
  SELECT book_id, unnest([arg_min(edge_key, line_no), arg_max(edge_key, line_no)]) AS edge_key
  FROM edge_lines WHERE line <> '' GROUP BY book_id, page_index)
JOIN (SELECT book_id, count(*) AS n_pages FROM rd_pages GROUP BY ALL HAVING count(*) >= 4)
  USING (book_id)
WHERE length(edge_key) BETWEEN 2 AND 90 AND NOT regexp_matches(edge_key, '^\\p{N}*$')
GROUP BY book_id, edge_key, n_pages
HAVING count(*) >= greatest(3, ceil(n_pages * CAST(0.12 AS DOUBLE)))""")
sql.define("edge_free", """
SELECT p.book_id, p.page_index, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no), '') AS text
FROM rd_pages p LEFT JOIN (SELECT * FROM edge_lines WHERE (book_id, edge_key) NOT IN
  (SELECT (book_id, edge_key) FROM edge_repeats)) l USING (book_id, page_index)
GROUP BY ALL""")


def compacted(x: str) -> str:
    t = rf"regexp_replace({sql.despaced(x)}, '[ \t]+', ' ', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '([。！？.!?；;：:])\s*\n\s*', '\1' || chr(10), 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([^。！？.!?；;：:\s])\s*\n\s*(\S)', '\1 \2', 'g')"
    return sql.stripped(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")


ORACLE["c1_repeated_edge_lines"] = with_tables("SELECT book_id, edge_key, n FROM edge_repeats")
ORACLE["c2_compact_pages"] = with_tables(
    f"SELECT book_id, page_index, md5(text) AS digest_lines, md5({compacted('text')}) AS digest "
    "FROM edge_free"
)

for _fn in (s1_choose_page_text, s4_merge_refreshed_pages, s5_render_markdown,
            c1_repeated_edge_lines, c2_compact_pages):
    QUERIES[_fn.__name__] = _fn

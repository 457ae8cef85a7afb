"""Queries over page calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import sql
from pagework.catalog import toc as CT
from pagework.catalog.sql import with_tables
from pagework.operators import resolve as R
from pagework.plans.stage import stage
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def restarted(spark, sf):
    """Outline whose numbers restart at the sixth entry of odd books."""
    again = (F.col("book_id") % 2 == 1) & (F.col("ord") >= 5)
    return D.outline(spark, sf).withColumn(
        "printed_page",
        F.when(again, F.col("printed_page") - 25).otherwise(F.col("printed_page")),
    )


def toc_pages(spark, sf):
    return D.pages(spark, sf).where("page_index = 3").select("book_id", "page_index")


def searched(spark, sf):
    return CT.book_pages(spark, sf)


def prepared(spark, sf):
    segments = stage(R.pagination_segments(D.outline(spark, sf)), "segments")
    toc = toc_pages(spark, sf)
    candidates = stage(R.title_candidates(segments, searched(spark, sf), toc), "candidates")
    return segments, toc, candidates, R.first_content(segments, toc)


def r1_repair_digits(spark, sf):
    """Every second page number got a leading 1 with filling zeros."""
    o = D.outline(spark, sf)
    page = F.when(F.col("ord") % 2 == 0, F.col("printed_page") + 1000).otherwise(
        F.col("printed_page"))
    return R.repair_page_digits(o.withColumn("printed_page", page), CT.sizes(spark, sf)).select(
        "book_id", "ord", "printed_page")


def r2_segments(spark, sf):
    return R.pagination_segments(restarted(spark, sf)).select("book_id", "ord", "segment")


def r3_title_candidates(spark, sf):
    return prepared(spark, sf)[2].select("book_id", "ord", "page_index", "score")


def r4_offset_consensus(spark, sf):
    segments, _, candidates, bounds = prepared(spark, sf)
    return R.offset_consensus(segments, candidates, bounds)


def r5_monotonic_anchors(spark, sf):
    segments, _, candidates, bounds = prepared(spark, sf)
    offsets = R.offset_consensus(segments, candidates, bounds)
    return R.monotonic_anchors(segments, candidates, offsets).select("book_id", "ord", "anchor")


def r6_page_label_map(spark, sf):
    return R.page_label_map(D.pages(spark, sf))


def r7_estimate_page(spark, sf):
    """Anchors of every third entry only, from the truth."""
    segments = R.pagination_segments(restarted(spark, sf))
    anchors = segments.where("ord % 3 = 1").select(
        "book_id", "segment", "ord", F.col("page_index").alias("anchor"))
    bounds = R.first_content(segments, toc_pages(spark, sf))
    return R.estimate_page(segments, anchors, bounds)


def r8_resolve_with_labels(spark, sf):
    pages = searched(spark, sf).join(
        D.pages(spark, sf).select("book_id", "page_index", "page_label"), ["book_id", "page_index"])
    return R.resolve_outline(D.outline(spark, sf).drop("page_index"), pages, toc_pages(spark, sf))


def r8_resolve_outline(spark, sf):
    """Labels unknown: anchors and estimates decide."""
    pages = searched(spark, sf).withColumn("page_label", F.lit(None).cast("string"))
    return R.resolve_outline(D.outline(spark, sf).drop("page_index"), pages, toc_pages(spark, sf))


def t19_calibration_pages(spark, sf):
    segments = R.pagination_segments(restarted(spark, sf))
    return R.calibration_pages(segments, D.pages(spark, sf), toc_pages(spark, sf))


sql.define("restarts", """
SELECT * REPLACE (CASE WHEN book_id % 2 = 1 AND ord >= 5 THEN printed_page - 25 ELSE printed_page END
  AS printed_page) FROM rd_outline""")
sql.define("restart_segments", """
SELECT *, sum(CASE WHEN p - printed_page >= 5 AND printed_page <= greatest(3, floor(p / 3)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY book_id ORDER BY ord) AS segment
FROM (SELECT *, lag(printed_page) OVER (PARTITION BY book_id ORDER BY ord) AS p FROM restarts)""")
ORACLE["r1_repair_digits"] = with_tables("SELECT book_id, ord, printed_page FROM rd_outline")
ORACLE["r2_segments"] = with_tables(
    "SELECT book_id, ord, CAST(segment AS BIGINT) AS segment FROM restart_segments"
)
_NOSEQ = CT._NOSEQ
sql.define("title_alternatives", f"""
SELECT DISTINCT book_id, ord, k FROM (SELECT book_id, ord, unnest([{sql.key('title')}, {sql.key(_NOSEQ)}]) AS k
  FROM rd_outline) WHERE length(k) >= 2""")
sql.define("page_heads", f"""
SELECT book_id, page_index, {sql.key("left(array_to_string(string_split(text, chr(10))[1:18], ' '), 900)")} AS head,
  list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql.key('l')}), lambda k: k <> '') AS lines
FROM book_texts WHERE page_index <> 3""")
_GRAMS = lambda x: (f"list_distinct(list_transform(range(1, greatest(2, length({x}))), "  # noqa: E731
                    f"lambda i: substr({x}, i, 2)))")
sql.define("candidates", f"""
SELECT book_id, ord, page_index, score FROM (SELECT *, row_number() OVER (PARTITION BY book_id, ord
    ORDER BY score DESC, page_index) AS r FROM (
  SELECT book_id, ord, page_index, max(round(greatest(by_line, loose), 6)) AS score FROM (
    SELECT a.book_id, a.ord, h.page_index,
      CASE WHEN list_contains(h.lines, a.k) THEN 1.0
        WHEN len(list_filter(h.lines, lambda l: starts_with(l, a.k) AND length(l) <= length(a.k) + 12)) > 0 THEN 0.99
        WHEN len(list_filter(h.lines, lambda l: contains(l, a.k) AND length(l) <= length(a.k) * 3 + 8)) > 0 THEN 0.97
        ELSE 0.0 END AS by_line,
      CASE WHEN length(a.k) <= 3 THEN 0.0 WHEN starts_with(h.head, a.k) THEN 1.0
        WHEN contains(h.head, a.k) THEN 0.94
        ELSE len(list_intersect({_GRAMS('a.k')}, {_GRAMS('left(h.head, greatest(length(a.k) * 4, 100))')}))
          / len({_GRAMS('a.k')}) END AS loose
    FROM title_alternatives a JOIN page_heads h USING (book_id) WHERE h.head <> '')
  GROUP BY ALL) WHERE score >= 0.82) WHERE r <= 6""")
sql.define("votes", """
SELECT c.book_id, c.ord, c.page_index - o.printed_page AS offset_, c.score FROM candidates c
JOIN rd_outline o USING (book_id, ord)""")
sql.define("offsets", """
SELECT book_id, o AS offset_ FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, weight DESC,
    abs(3 - o), o) AS r FROM (
  SELECT book_id, o, count(*) AS n, round(sum(s), 6) AS weight FROM (
    SELECT v.book_id, d.offset_ AS o, v.ord, max(v.score) AS s FROM (SELECT DISTINCT book_id, offset_ FROM votes) d
    JOIN votes v ON v.book_id = d.book_id AND abs(v.offset_ - d.offset_) <= 1 GROUP BY ALL) GROUP BY ALL))
WHERE r = 1 AND n >= 2""")
ORACLE["r3_title_candidates"] = with_tables("SELECT book_id, ord, page_index, score FROM candidates")
ORACLE["r4_offset_consensus"] = with_tables(
    'SELECT book_id, CAST(0 AS BIGINT) AS segment, offset_ AS "offset" FROM offsets'
)
sql.define("anchor_picks", """
WITH RECURSIVE options AS (SELECT c.book_id, c.ord, c.page_index, c.score, o.printed_page, f.offset_,
    dense_rank() OVER (PARTITION BY c.book_id ORDER BY c.ord) AS step FROM candidates c
    JOIN rd_outline o USING (book_id, ord) LEFT JOIN offsets f USING (book_id)),
  picks(book_id, step, ord, page, printed) AS (
    SELECT DISTINCT book_id, CAST(0 AS BIGINT), -1, CAST(NULL AS INT), CAST(NULL AS INT) FROM options
    UNION ALL
    SELECT book_id, step, ord, page_index, printed_page FROM (
      SELECT *, row_number() OVER (PARTITION BY book_id, step ORDER BY late DESC, v DESC, score DESC, page_index) AS r
      FROM (SELECT o.book_id, o.step, o.ord, o.page_index, o.printed_page, o.score,
          p.page IS NULL OR o.page_index >= p.page AS late,
          round(o.score * 20 + CASE WHEN o.offset_ IS NULL THEN 0
            WHEN abs(o.page_index - o.printed_page - o.offset_) <= 1 THEN 5
            ELSE abs(o.page_index - o.printed_page - o.offset_) * CAST(-0.7 AS DOUBLE) END
          + CASE WHEN p.page IS NOT NULL AND o.printed_page >= p.printed THEN
              abs((o.page_index - p.page) - (o.printed_page - p.printed)) * CAST(-0.08 AS DOUBLE)
            ELSE o.page_index * CAST(-0.0001 AS DOUBLE) END, 9) AS v
        FROM picks p JOIN options o ON o.book_id = p.book_id AND o.step = p.step + 1)) WHERE r = 1)
SELECT book_id, ord, page AS anchor FROM picks WHERE step > 0""")
ORACLE["r5_monotonic_anchors"] = with_tables("SELECT book_id, ord, anchor FROM anchor_picks")
ORACLE["r6_page_label_map"] = with_tables(
    """SELECT book_id, CASE page_label WHEN 'i' THEN 1 WHEN 'ii' THEN 2 WHEN 'iii' THEN 3 WHEN 'iv' THEN 4
      ELSE CAST(page_label AS INT) END AS value,
      CASE WHEN page_index < 4 THEN 'roman' ELSE 'arabic' END AS style, page_index
    FROM (SELECT * REPLACE (CASE WHEN page_label IN ('i', 'ii', 'iii', 'iv') THEN page_label ELSE page_label END
      AS page_label) FROM rd_pages)"""
)


def estimate_sql(entries: str, anchors: str) -> str:
    """``entries``: book_id, ord, segment, printed_page; ``anchors``: book_id,
    segment, ord, printed_page, page.  Contents is physical page 3."""
    return f"""
SELECT book_id, ord, CAST(CASE WHEN front THEN least(raw, 2) ELSE greatest(raw, 4) END AS INT) AS estimate FROM (
  SELECT e.*, CASE WHEN b.printed_page > a.printed_page THEN round(a.page + (e.printed_page - a.printed_page)
        / (b.printed_page - a.printed_page) * (b.page - a.page))
      WHEN a.ord IS NULL AND b.ord IS NULL THEN CASE WHEN final > e.segment THEN e.printed_page - 1
        ELSE 4 + e.printed_page - 1 END
      WHEN b.ord IS NULL OR (a.ord IS NOT NULL AND e.ord - a.ord <= b.ord - e.ord)
        THEN a.page + e.printed_page - a.printed_page
      ELSE b.page + e.printed_page - b.printed_page END AS raw,
    CASE WHEN n > 0 THEN early > floor(n / 2) ELSE final > e.segment END AS front
  FROM {entries} e JOIN (SELECT book_id, max(segment) AS final FROM {entries} GROUP BY ALL) USING (book_id)
  LEFT JOIN (SELECT book_id, segment, count(*) AS n, count(*) FILTER (WHERE page < 4) AS early FROM {anchors}
    GROUP BY ALL) s ON s.book_id = e.book_id AND s.segment = e.segment
  LEFT JOIN LATERAL (SELECT * FROM {anchors} x WHERE x.book_id = e.book_id AND x.segment = e.segment
    AND x.ord < e.ord ORDER BY x.ord DESC LIMIT 1) a ON true
  LEFT JOIN LATERAL (SELECT * FROM {anchors} x WHERE x.book_id = e.book_id AND x.segment = e.segment
    AND x.ord > e.ord ORDER BY x.ord LIMIT 1) b ON true)"""


sql.define("given_anchors", """
SELECT book_id, segment, ord, printed_page, page_index AS page FROM restart_segments WHERE ord % 3 = 1""")
ORACLE["r7_estimate_page"] = with_tables(estimate_sql("restart_segments", "given_anchors"))
_RESOLVED = lambda page, joins: f"""SELECT book_id, ord, title, page_index, level FROM (SELECT *, row_number() OVER (
    PARTITION BY book_id, {sql.key('title')}, page_index ORDER BY ord) AS copy FROM (
  SELECT r.book_id, r.ord, {sql.stripped('r.title')} AS title, r.level,
    CAST(least(greatest({page}, 0), b.n_pages - 1) AS INT) AS page_index
  FROM rd_outline r JOIN page_totals b USING (book_id) {joins})
  WHERE length(title) BETWEEN 2 AND 180) WHERE copy = 1"""  # noqa: E731
ORACLE["r8_resolve_with_labels"] = with_tables(
    _RESOLVED(page="r.printed_page + 3", joins="")
)
sql.define("one_segment", "SELECT *, 0 AS segment FROM rd_outline")
sql.define("found_anchors", """
SELECT p.book_id, 0 AS segment, p.ord, o.printed_page, p.anchor AS page FROM anchor_picks p
JOIN rd_outline o USING (book_id, ord)""")
sql.define("estimates", estimate_sql("one_segment", "found_anchors"))
ORACLE["r8_resolve_outline"] = with_tables(
    _RESOLVED(
        page="coalesce(p.anchor, e.estimate)",
        joins="LEFT JOIN anchor_picks p USING (book_id, ord) LEFT JOIN estimates e USING (book_id, ord)",
    )
)
ORACLE["t19_calibration_pages"] = with_tables(
    """SELECT DISTINCT s.book_id, p.page_index FROM (SELECT *, max(segment) OVER (PARTITION BY book_id) AS final
      FROM restart_segments) s JOIN rd_pages p ON p.book_id = s.book_id
      AND abs(p.page_index - (CASE WHEN s.segment < final THEN 0 ELSE 4 END + s.printed_page - 1)) <= 3
    WHERE s.level <= 1 AND s.printed_page > 0 AND NOT p.came_from_ocr AND p.page_index <> 3"""
)

for _fn in (r1_repair_digits, r2_segments, r3_title_candidates, r4_offset_consensus,
            r5_monotonic_anchors, r6_page_label_map, r7_estimate_page, r8_resolve_with_labels,
            r8_resolve_outline, t19_calibration_pages):
    QUERIES[_fn.__name__] = _fn

"""Queries over outline structure and chapter lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import chunks as K
from pagework.operators import outline as O
from pagework.plans import reading as R
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}
SEP = " › "


def joined(path: str):
    return F.array_join(path, SEP).alias("path")


def o1_outline_paths(spark, sf):
    return O.outline_paths(D.outline(spark, sf)).select("book_id", "ord", joined("path"))


def o2_chapter_for_page(spark, sf):
    paths = O.outline_paths(D.outline(spark, sf))
    return O.chapter_for_page(D.pages(spark, sf), paths).select(
        "book_id", "page_index", joined("path")
    )


def doubled_outline(spark, sf):
    """Two headings per outline page: the entry and a deeper one."""
    o = D.outline(spark, sf)
    second = F.concat(F.split(F.col("title"), " ")[0], F.lit(" "), F.col("ord").cast("string"))
    return o.withColumn("ord", F.col("ord") * 2).unionByName(
        o.withColumn("title", second)
        .withColumn("level", F.col("level") + 1)
        .withColumn("ord", F.col("ord") * 2 + 1)
    )


def o2_chapter_for_passage(spark, sf):
    """Marks against two headings per page."""
    paths = O.outline_paths(doubled_outline(spark, sf))
    passages = D.marks(spark, sf).withColumnRenamed("mark_id", "passage_id")
    return O.chapter_for_passage(
        passages.select("book_id", "page_index", "passage_id", "text"), paths
    ).select("passage_id", joined("path"))


def o3_page_segments(spark, sf):
    source = D.pages(spark, sf).select(
        "book_id", "page_index", K.chunk_source("text").alias("text")
    )
    segments = O.page_segments(source, O.outline_paths(D.outline(spark, sf)))
    return segments.select(
        "book_id", "page_index", "seg_no", joined("path"), F.md5("text").alias("digest")
    )


def o5_chapter_span(spark, sf):
    """Spans with their chunk counts (chunks of the outline-free index)."""
    pages = D.pages(spark, sf)
    spans = O.chapter_spans(D.outline(spark, sf), O.page_counts(pages))
    counted = O.count_in_spans(spans, R.build_chunks(pages, None))
    return counted.select(
        "book_id", "ord", "start_page", "end_page",
        (F.col("end_row") - F.col("first_row")).alias("n_chunks"),
    )


def o5_pages_in_span(spark, sf):
    pages = D.pages(spark, sf)
    spans = O.chapter_spans(D.outline(spark, sf), O.page_counts(pages))
    rows = O.rows_in_spans(spans.select("book_id", "ord", "start_page", "end_page"),
                           pages.select("book_id", "page_index"))
    return rows.select("book_id", "ord", "page_index")


def o6_sibling_chapters(spark, sf):
    """Siblings, with the last chunk page of the previous and the first chunk
    page of the next one."""
    return O.siblings(D.outline(spark, sf)).select(
        "book_id",
        "ord",
        F.col("previous.ord").alias("previous_ord"),
        F.col("following.ord").alias("following_ord"),
    )


def o6_sibling_chunks(spark, sf):
    """The last two chunks of the previous sibling, the first two of the next."""
    pages = D.pages(spark, sf)
    o = D.outline(spark, sf)
    chunks = R.build_chunks(pages, None)
    numbers = K.number_chunks(chunks.select("book_id", "page_index", "seg_no", "piece_no"))
    spans = O.count_in_spans(O.chapter_spans(o, O.page_counts(pages)), chunks).select(
        "book_id", "ord", "first_row", "end_row"
    )
    s = O.siblings(o)
    keep = F.lit(2)
    sides = []
    for side in ("previous", "following"):
        other = spans.withColumnRenamed("ord", "other")
        near = s.select("book_id", "ord", F.col(f"{side}.ord").alias("other")).join(
            other, ["book_id", "other"]
        )
        first = F.col("first_row")
        last = F.col("end_row") - 1
        span = (
            F.sequence(F.greatest(first, last - keep + 1), last)
            if side == "previous"
            else F.sequence(first, F.least(last, first + keep - 1))
        )
        sides.append(
            near.where("end_row > first_row").select(
                "book_id", "ord", F.lit(side).alias("side"), F.explode(span).alias("chunk_no")
            )
        )
    wanted = sides[0].unionByName(sides[1])
    return wanted.join(numbers, ["book_id", "chunk_no"]).select(
        "book_id", "ord", "side", "chunk_no", "page_index", "piece_no"
    )


def o7_outline_signature(spark, sf):
    return O.outline_signature(D.outline(spark, sf))


sql.define("paths_of", """
SELECT *, list_filter([t0, t1, t2], lambda x: x IS NOT NULL)[1:depth + 1] AS path FROM (
  SELECT *, last_value(CASE WHEN depth = 0 THEN title END IGNORE NULLS) OVER w AS t0,
    last_value(CASE WHEN depth = 1 THEN title END IGNORE NULLS) OVER w AS t1,
    last_value(CASE WHEN depth = 2 THEN title END IGNORE NULLS) OVER w AS t2
  FROM (SELECT *, i + least(0, min(level - i) OVER (PARTITION BY book_id ORDER BY ord)) AS depth
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS i FROM rd_outline))
  WINDOW w AS (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
sql.define("doubled", """
SELECT book_id, ord * 2 AS ord, page_index, level, title FROM rd_outline
UNION ALL SELECT book_id, ord * 2 + 1, page_index, level + 1,
  string_split(title, ' ')[1] || ' ' || ord FROM rd_outline""")

ORACLE["o1_outline_paths"] = with_tables(
    f"SELECT book_id, ord, array_to_string(path, '{SEP}') AS path FROM paths_of"
)
ORACLE["o2_chapter_for_page"] = with_tables(
    f"""SELECT p.book_id, p.page_index, coalesce(array_to_string(
      CASE WHEN h.page_index = p.page_index AND h.level > 0 THEN h.path[1:len(h.path) - 1]
           ELSE h.path END, '{SEP}'), '') AS path
    FROM rd_pages p LEFT JOIN LATERAL (SELECT * FROM paths_of o WHERE o.book_id = p.book_id
      AND o.page_index <= p.page_index ORDER BY ord DESC LIMIT 1) h ON true"""
)
_COMPACT = lambda x: rf"lower(regexp_replace({sql.normalized(x)}, '\s', '', 'g'))"
ORACLE["o2_chapter_for_passage"] = with_tables(
    f"""SELECT m.mark_id AS passage_id, coalesce(array_to_string(h.path, '{SEP}'), '') AS path
    FROM rd_marks m LEFT JOIN LATERAL (
      SELECT path FROM doubled_paths o WHERE o.book_id = m.book_id AND o.page_index <= m.page_index
      ORDER BY (o.page_index = m.page_index AND contains({_COMPACT('m.text')}, {_COMPACT('o.title')}))
        DESC, ord DESC LIMIT 1) h ON true""",
    doubled_paths="""
SELECT *, list_filter([t0, t1, t2, t3], lambda x: x IS NOT NULL)[1:depth + 1] AS path FROM (
  SELECT *, last_value(CASE WHEN depth = 0 THEN title END IGNORE NULLS) OVER w AS t0,
    last_value(CASE WHEN depth = 1 THEN title END IGNORE NULLS) OVER w AS t1,
    last_value(CASE WHEN depth = 2 THEN title END IGNORE NULLS) OVER w AS t2,
    last_value(CASE WHEN depth = 3 THEN title END IGNORE NULLS) OVER w AS t3
  FROM (SELECT *, i + least(0, min(level - i) OVER (PARTITION BY book_id ORDER BY ord)) AS depth
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS i FROM doubled))
  WINDOW w AS (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)


def chunk_text(x: str) -> str:
    t = rf"regexp_replace({sql.despaced(x)}, '[ \t]+', ' ', 'g')"
    return sql.stripped(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")


sql.define("chunk_pages", f"""
SELECT * FROM (SELECT book_id, page_index, {chunk_text('text')} AS text FROM rd_pages)
WHERE text <> ''""")
# At most one heading per page here; it is searched in lower case.
sql.define("segments", f"""
SELECT book_id, page_index, CAST(row_number() OVER (PARTITION BY book_id, page_index ORDER BY part) - 1
  AS INT) AS seg_no, text, path FROM (
  SELECT book_id, page_index, 0 AS part, {sql.stripped('left(text, pos - 1)')} AS text,
    CASE WHEN len(before) = 0 THEN path ELSE before END AS path FROM placed WHERE pos > 1
  UNION ALL
  SELECT book_id, page_index, 1, {sql.stripped('substr(text, greatest(pos, 1))')},
    coalesce(path, before) FROM placed) WHERE text <> ''""")
sql.TABLES["placed"] = """
SELECT p.book_id, p.page_index, p.text, o.path, coalesce(b.path, []) AS before,
  coalesce(strpos(lower(p.text), lower(o.title)), 0) AS pos
FROM chunk_pages p LEFT JOIN paths_of o USING (book_id, page_index)
LEFT JOIN LATERAL (SELECT path FROM paths_of x WHERE x.book_id = p.book_id
  AND x.page_index < p.page_index ORDER BY x.page_index DESC, ord DESC LIMIT 1) b ON true"""
sql.TABLES["segments"] = sql.TABLES.pop("segments")

ORACLE["o3_page_segments"] = with_tables(
    f"SELECT book_id, page_index, seg_no, array_to_string(path, '{SEP}') AS path, "
    "md5(text) AS digest FROM segments"
)


def cut_sql(source: str) -> str:
    """Recursive form of the window rule over (book_id, page_index, seg_no, text)."""
    tail = "substr(text, start_at + 1020, 180)"
    return f"""
SELECT book_id, page_index, seg_no, CAST(row_number() OVER (PARTITION BY book_id, page_index, seg_no
  ORDER BY step) - 1 AS INT) AS piece_no, piece AS text FROM (
  WITH RECURSIVE steps(book_id, page_index, seg_no, text, step, start_at, stop_at) AS (
    SELECT book_id, page_index, seg_no, text, 0, 1, {{end}} FROM (
      SELECT *, 1 AS start_at FROM {source})
    UNION ALL
    SELECT book_id, page_index, seg_no, text, step, start_at, {{end}} FROM (
      SELECT book_id, page_index, seg_no, text, step + 1 AS step,
        greatest(start_at + 1, stop_at + 1 - least(180, stop_at + 1 - start_at)) AS start_at
      FROM steps WHERE stop_at < length(text)))
  SELECT book_id, page_index, seg_no, step,
    {sql.stripped('substr(text, start_at, stop_at - start_at + 1)')} AS piece FROM steps)
WHERE piece <> ''""".replace(
        "{end}",
        f"CASE WHEN length(text) - start_at + 1 <= 1200 THEN length(text) "
        f"WHEN regexp_matches({tail}, '[.!?。！？\\n]') THEN start_at + 1019 + "
        f"length(regexp_extract({tail}, '(?s)^.*[.!?。！？\\n]')) ELSE start_at + 1199 END",
    )


sql.define("plain_segments", "SELECT book_id, page_index, 0 AS seg_no, text FROM chunk_pages")
sql.define("plain_chunks", cut_sql("plain_segments"))
sql.define("cut_chunks", cut_sql("segments"))
sql.define("chunks", """
SELECT c.*, s.path, s.path[len(s.path)] AS title, CAST(row_number() OVER (PARTITION BY c.book_id
  ORDER BY c.page_index, c.seg_no, c.piece_no) - 1 AS BIGINT) AS chunk_no
FROM cut_chunks c JOIN segments s USING (book_id, page_index, seg_no)""")
sql.define("book_sizes", "SELECT book_id, max(page_index) + 1 AS n_pages FROM rd_pages GROUP BY ALL")
sql.define("spans", """
SELECT o.*, CAST(coalesce((SELECT min(x.page_index) FROM rd_outline x WHERE x.book_id = o.book_id
  AND x.page_index > o.page_index AND x.level <= o.level), b.n_pages) AS INT) AS end_page
FROM rd_outline o JOIN book_sizes b USING (book_id)""")
sql.define("plain_numbered", """
SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_index, piece_no) - 1 AS chunk_no
FROM plain_chunks""")
sql.define("sibling_pairs", """
SELECT book_id, ord, lag(ord) OVER w AS previous_ord, lead(ord) OVER w AS following_ord
FROM rd_outline WINDOW w AS (PARTITION BY book_id, level ORDER BY ord)""")

ORACLE["o5_chapter_span"] = with_tables(
    """SELECT s.book_id, s.ord, s.page_index AS start_page, s.end_page, (SELECT count(*) FROM plain_chunks c
      WHERE c.book_id = s.book_id AND c.page_index >= s.page_index AND c.page_index < s.end_page) AS n_chunks
    FROM spans s"""
)
ORACLE["o5_pages_in_span"] = with_tables(
    """SELECT s.book_id, s.ord, p.page_index FROM spans s JOIN rd_pages p ON p.book_id = s.book_id
      AND p.page_index >= s.page_index AND p.page_index < s.end_page"""
)
ORACLE["o6_sibling_chapters"] = with_tables(
    "SELECT book_id, ord, previous_ord, following_ord FROM sibling_pairs"
)
ORACLE["o6_sibling_chunks"] = with_tables(
    """SELECT book_id, ord, side, chunk_no, page_index, piece_no FROM (
      SELECT p.book_id, p.ord, 'previous' AS side, c.chunk_no, c.page_index, c.piece_no,
        row_number() OVER (PARTITION BY p.book_id, p.ord ORDER BY c.chunk_no DESC) AS r
      FROM sibling_pairs p JOIN spans s ON s.book_id = p.book_id AND s.ord = p.previous_ord
      JOIN plain_numbered c ON c.book_id = p.book_id AND c.page_index >= s.page_index AND c.page_index < s.end_page
      UNION ALL
      SELECT p.book_id, p.ord, 'following', c.chunk_no, c.page_index, c.piece_no,
        row_number() OVER (PARTITION BY p.book_id, p.ord ORDER BY c.chunk_no) AS r
      FROM sibling_pairs p JOIN spans s ON s.book_id = p.book_id AND s.ord = p.following_ord
      JOIN plain_numbered c ON c.book_id = p.book_id AND c.page_index >= s.page_index AND c.page_index < s.end_page)
    WHERE r <= 2"""
)
ORACLE["o7_outline_signature"] = with_tables(
    """SELECT book_id, sha256(string_agg(d, chr(30) ORDER BY b)) AS signature FROM (SELECT book_id, ord // 4096 AS b,
      sha256(string_agg(ord || '|' || page_index || '|' || level || '|' || title, chr(30) ORDER BY ord)) AS d
      FROM rd_outline GROUP BY ALL) GROUP BY ALL"""
)

for _fn in (o1_outline_paths, o2_chapter_for_page, o2_chapter_for_passage, o3_page_segments,
            o5_chapter_span, o5_pages_in_span, o6_sibling_chapters, o6_sibling_chunks,
            o7_outline_signature):
    QUERIES[_fn.__name__] = _fn

"""Queries over notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import notes as B
from pagework.operators import outline as O
from pagework.operators.pages import heading_line
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def o4_note_chapter(spark, sf):
    passages = D.marks(spark, sf).withColumnRenamed("mark_id", "passage_id")
    return O.note_chapter(passages, D.pages(spark, sf), D.outline(spark, sf)).select(
        "passage_id", "chapter"
    )


def titles(spark, sf):
    """Each book is called like its third chapter."""
    return D.outline(spark, sf).where("ord = 2").select("book_id", "title")


def b1_note_skeleton(spark, sf):
    return B.note_skeleton(D.outline(spark, sf), titles(spark, sf))


def b2_missing_headings(spark, sf):
    """Notes written before every third chapter was known."""
    o = D.outline(spark, sf)
    old = B.note_skeleton(o.where("ord % 3 <> 1"), titles(spark, sf))
    return B.missing_headings(o, old)


def b3_mark_block(spark, sf):
    return D.marks(spark, sf).select("mark_id", B.mark_block().alias("block"))


def b4_conversation_block(spark, sf):
    turns = D.turns(spark, sf)
    pages = turns.where("anchor_page IS NOT NULL").select(
        "conv_id", F.col("anchor_page").alias("page_index")
    )
    return B.conversation_block(turns, pages)


def mark_blocks(spark, sf):
    marks = D.marks(spark, sf)
    chapters = o4_note_chapter(spark, sf).withColumnRenamed("passage_id", "mark_id")
    return marks.join(chapters, "mark_id").select(
        "book_id", "chapter", "page_index",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.col("mark_id").alias("block_id"), B.mark_block().alias("block"),
    )


def note_lines(spark, sf):
    """Notes that readers have written in: remarks below every third heading, with
    blank lines, and below their own notes, which every fifth book does not have.
    Every seventh heading is missing."""
    o = D.outline(spark, sf)
    place = (F.col("ord").cast("long") + 1) * 10
    heads = o.where("ord % 7 <> 5").select("book_id", place.alias("line_no"), heading_line("level", "title").alias("line"))
    remarks = o.where("ord % 3 = 0").select(
        "book_id", F.explode(F.array(
            F.struct((place + 1).alias("line_no"), F.lit("").alias("line")),
            F.struct((place + 2).alias("line_no"), F.concat(F.lit("手记 "), "title").alias("line")),
            F.struct((place + 3).alias("line_no"), F.lit("  ").alias("line")),
        )).alias("r")).select("book_id", "r.*")
    ends = o.groupBy("book_id").agg(((F.max("ord").cast("long") + 2) * 10).alias("line_no")).where("book_id % 5 <> 0")
    tails = ends.select("book_id", "line_no", F.lit(B.TAIL).alias("line"))
    own = ends.select("book_id", (F.col("line_no") + 1).alias("line_no"), F.lit("后记").alias("line"))
    return heads.unionByName(remarks).unionByName(tails).unionByName(own)


def b5_insert_under_chapter(spark, sf):
    note = B.insert_under_chapter(note_lines(spark, sf), mark_blocks(spark, sf))
    return note.select(
        "book_id", "line_no", "kind", "page_index", "created_at", "block_id",
        F.md5("block").alias("digest"),
    )


def b6_skip_existing_blocks(spark, sf):
    blocks = D.marks(spark, sf).select("mark_id", "book_id", B.mark_block().alias("block"))
    written = blocks.where("mark_id % 7 = 0")
    return B.skip_existing_blocks(blocks, written).select("mark_id", "book_id")


ORACLE["o4_note_chapter"] = with_tables(
    f"""SELECT m.mark_id AS passage_id, CASE WHEN h.title IS NULL THEN (SELECT o.title FROM rd_outline o
        WHERE o.book_id = m.book_id AND o.page_index < m.page_index ORDER BY ord DESC LIMIT 1)
      WHEN length({sql.key('h.title')}) >= 4 AND length({sql.key('m.text')}) >= 4 THEN h.title
      ELSE coalesce((SELECT o.title FROM rd_outline o WHERE o.book_id = m.book_id AND o.ord < h.ord
        AND o.level < h.level ORDER BY ord DESC LIMIT 1), h.title) END AS chapter
    FROM rd_marks m LEFT JOIN rd_outline h USING (book_id, page_index)"""
)
sql.define("note_titles", "SELECT book_id, title FROM rd_outline WHERE ord = 2")
_HEAD = "repeat('#', least(6, greatest(2, level + 2))) || ' ' || o.title"
ORACLE["b1_note_skeleton"] = with_tables(
    f"""SELECT book_id, -1 AS position, '# ' || title AS line FROM note_titles
    UNION ALL SELECT book_id, 2000000000, '## 我的笔记' FROM note_titles
    UNION ALL SELECT o.book_id, o.ord, {_HEAD} FROM rd_outline o JOIN note_titles t USING (book_id)
      WHERE lower(trim(o.title)) <> lower(trim(t.title))"""
)
ORACLE["b2_missing_headings"] = with_tables(
    f"""SELECT o.book_id, o.ord, {_HEAD} AS line FROM rd_outline o JOIN note_titles t USING (book_id)
    WHERE {_HEAD} <> '# ' || t.title AND NOT EXISTS (SELECT 1 FROM rd_outline x WHERE x.book_id = o.book_id
      AND x.ord % 3 <> 1 AND x.level = o.level AND x.title = o.title
      AND lower(trim(x.title)) <> lower(trim(t.title)))"""
)


def block_sql() -> str:
    esc = (rf"regexp_replace(replace(replace(replace(replace({sql.inlined('text')}, '\', '\\'), "
           r"'&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([`*_\[\]])', '\\\1', 'g')")
    page = "' · 第 ' || (page_index + 1) || ' 页'"
    note = "note IS NOT NULL AND note <> ''"
    return (
        f"CASE WHEN kind = 'annotation' THEN '> [!success] 批注' || {page} || chr(10) || '> *原文：* ' || {esc} "
        f"|| CASE WHEN {note} THEN chr(10) || '>' || chr(10) || '> ' || note ELSE '' END "
        f"ELSE '> [!' || CASE color WHEN 'red' THEN 'danger' WHEN 'blue' THEN 'info' ELSE 'warning' END "
        f"|| '] 划线' || {page} || chr(10) || '> ' || {esc} || CASE WHEN {note} THEN chr(10) || chr(10) || "
        f"'> [!note] 批注' || chr(10) || '> ' || note ELSE '' END END"
    )


ORACLE["b3_mark_block"] = with_tables(f"SELECT mark_id, {block_sql()} AS block FROM rd_marks")
ORACLE["b4_conversation_block"] = with_tables(
    """SELECT conv_id, -1 AS turn, '> [!example]+ AI 讨论' || coalesce(' · 第 ' || string_agg(DISTINCT
      anchor_page + 1, '、' ORDER BY anchor_page + 1) || ' 页', '') AS block FROM rd_turns GROUP BY conv_id
    UNION ALL SELECT conv_id, turn, CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN '> ' || chr(10)
      ELSE '' END || '> **' || CASE role WHEN 'user' THEN '问题' ELSE '伴读' END || '：** '
      || replace(content, chr(10), chr(10) || '> ') FROM rd_turns"""
)
ORACLE["b5_insert_under_chapter"] = with_tables(
    f"""SELECT book_id, line_no, 0 AS kind, NULL::INT AS page_index, NULL::VARCHAR AS created_at,
      NULL::BIGINT AS block_id, md5(line) AS digest FROM written
    UNION ALL SELECT DISTINCT book_id, line_no, 0, NULL, NULL, NULL, md5('## 我的笔记') FROM placed_marks WHERE added
    UNION ALL SELECT book_id, line_no, 1, page_index, strftime(created_at, '%Y-%m-%d %H:%M:%S'), mark_id,
      md5({block_sql()}) FROM placed_marks""",
    mark_chapters=ORACLE["o4_note_chapter"][ORACLE["o4_note_chapter"].index("SELECT m.mark_id AS passage_id"):],
    written=f"""SELECT book_id, (ord + 1) * 10 AS line_no, {_HEAD} AS line FROM rd_outline o WHERE ord % 7 <> 5
      UNION ALL SELECT book_id, (ord + 1) * 10 + k, CASE k WHEN 1 THEN '' WHEN 2 THEN '手记 ' || title ELSE '  ' END
        FROM rd_outline, (VALUES (1), (2), (3)) t(k) WHERE ord % 3 = 0
      UNION ALL SELECT book_id, (max(ord) + 2) * 10 + k, CASE k WHEN 0 THEN '## 我的笔记' ELSE '后记' END
        FROM rd_outline, (VALUES (0), (1)) t(k) WHERE book_id % 5 <> 0 GROUP BY book_id, k""",
    heads="SELECT *, lead(line_no) OVER (PARTITION BY book_id ORDER BY line_no) AS upto FROM written "
          "WHERE regexp_matches(line, '^#{2,6}\\s+')",
    placed_marks="""SELECT m.*, coalesce(c.last, t.line_no, w.last + 1) AS line_no, c.last IS NULL AND t.line_no IS NULL AS added
      FROM rd_marks m JOIN mark_chapters k ON k.passage_id = m.mark_id
      LEFT JOIN (SELECT h.book_id, h.name, max(w.line_no) AS last
        FROM (SELECT book_id, lower(trim(regexp_replace(line, '^#+\\s+', ''))) AS name, min(line_no) AS line_no,
            min_by(upto, line_no) AS upto FROM heads GROUP BY ALL) h
        JOIN written w ON w.book_id = h.book_id AND w.line_no >= h.line_no AND trim(w.line) <> ''
          AND (h.upto IS NULL OR w.line_no < h.upto) GROUP BY ALL) c
        ON c.book_id = m.book_id AND c.name = lower(trim(k.chapter))
      LEFT JOIN heads t ON t.book_id = m.book_id AND t.line = '## 我的笔记'
      JOIN (SELECT book_id, max(line_no) AS last FROM written GROUP BY ALL) w ON w.book_id = m.book_id""",
)
ORACLE["b6_skip_existing_blocks"] = with_tables(
    """SELECT mark_id, book_id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM blocks w
      WHERE w.book_id = b.book_id AND w.block = b.block AND w.mark_id % 7 = 0)""",
    blocks=f"SELECT mark_id, book_id, {block_sql()} AS block FROM rd_marks",
)

for _fn in (o4_note_chapter, b1_note_skeleton, b2_missing_headings, b3_mark_block,
            b4_conversation_block, b5_insert_under_chapter, b6_skip_existing_blocks):
    QUERIES[_fn.__name__] = _fn

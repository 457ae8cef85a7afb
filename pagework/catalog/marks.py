"""Queries over marks (M1-M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import marks as M
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}
GROUP = ["book_id", "merge_group"]


def m1_filter_marks(spark, sf):
    marks = D.marks(spark, sf)
    yellow = M.filter_marks(marks, "yellow", " The ").withColumn("view", F.lit("yellow"))
    notes = M.filter_marks(marks, "annotation", "NOTE").withColumn("view", F.lit("annotation"))
    return yellow.unionByName(notes).select("view", "mark_id", "page_index")


def m2_merge_marks(spark, sf):
    marks = D.marks(spark, sf)
    return M.merge_headers(marks, GROUP).select(
        *GROUP, "mark_id", "n_parts", "n_notes", "page_index", "kind", "color"
    )


def m2_merge_parts(spark, sf):
    return M.merge_parts(D.marks(spark, sf), GROUP)


def m3_selection_text(spark, sf):
    return M.selection_lines(D.marks(spark, sf), GROUP)


def m4_pending(spark, sf):
    marks, turns = D.marks(spark, sf), D.turns(spark, sf)
    a = M.pending(marks, marks.where("exported").select("mark_id"), ["mark_id"], ["book_id"])
    key = ["conv_id", "turn"]
    b = M.pending(turns, turns.where("exported").select(*key), key, ["book_id"])
    return a.withColumn("what", F.lit("marks")).unionByName(b.withColumn("what", F.lit("turns")))


def m5_update_marks(spark, sf):
    """Recolour every fourth, turn every fifth into an annotation with a note,
    delete every sixth."""
    marks = D.marks(spark, sf)
    ids = F.col("mark_id")
    changes = marks.where((ids % 4 == 0) | (ids % 5 == 0)).select(
        "mark_id",
        F.when(ids % 4 == 0, F.lit("blue")).alias("color"),
        F.when(ids % 5 == 0, F.lit("annotation")).alias("kind"),
        F.when(ids % 5 == 0, F.lit("changed")).alias("note"),
    )
    left = M.delete_marks(marks, marks.where(ids % 6 == 0).select("mark_id"))
    return M.update_marks(left, changes).select("mark_id", "color", "kind", "note")


ORACLE["m1_filter_marks"] = with_tables(
    """SELECT 'yellow' AS view, mark_id, page_index FROM rd_marks WHERE color = 'yellow'
      AND (contains(lower(text), 'the') OR contains(lower(coalesce(note, '')), 'the'))
    UNION ALL SELECT 'annotation', mark_id, page_index FROM rd_marks WHERE kind = 'annotation'
      AND (contains(lower(text), 'note') OR contains(lower(coalesce(note, '')), 'note'))"""
)
ORACLE["m2_merge_marks"] = with_tables(
    """SELECT book_id, merge_group, first(mark_id ORDER BY page_index, created_at, mark_id) AS mark_id,
      count(*) AS n_parts, count(note) AS n_notes, min(page_index) AS page_index,
      CASE WHEN bool_and(kind = 'annotation') THEN 'annotation' ELSE 'highlight' END AS kind,
      coalesce(first(color ORDER BY page_index, created_at, mark_id) FILTER (WHERE kind = 'highlight'),
        first(color ORDER BY page_index, created_at, mark_id)) AS color
    FROM rd_marks GROUP BY ALL HAVING count(*) >= 2"""
)
_PLACED = """SELECT *, count(*) OVER (PARTITION BY book_id, merge_group) AS n, row_number() OVER (
  PARTITION BY book_id, merge_group ORDER BY page_index, created_at, mark_id) AS part_no FROM """
ORACLE["m2_merge_parts"] = with_tables(
    f"""SELECT book_id, merge_group, part_no, mark_id, '• ' || {sql.inlined('text')} AS text_line,
      '• ' || note AS note_line FROM ({_PLACED} rd_marks) WHERE n >= 2"""
)
_PART = sql.stripped(rf"regexp_replace(regexp_replace({sql.normalized('text')}, '\s*\n\s*', ' ', 'g'), "
                     r"'\s+', ' ', 'g')")
ORACLE["m3_selection_text"] = with_tables(
    f"""SELECT book_id, merge_group, part_no, CASE WHEN n > 1 THEN '• ' || part ELSE part END AS line
    FROM ({_PLACED} (SELECT *, {_PART} AS part FROM rd_marks WHERE {_PART} <> ''))"""
)
ORACLE["m4_pending"] = with_tables(
    """SELECT book_id, count(*) AS pending, 'marks' AS what FROM rd_marks WHERE NOT exported GROUP BY book_id
    UNION ALL SELECT book_id, count(*), 'turns' FROM rd_turns WHERE NOT exported GROUP BY book_id"""
)
ORACLE["m5_update_marks"] = with_tables(
    """SELECT mark_id, CASE WHEN mark_id % 4 = 0 THEN 'blue' ELSE color END AS color,
      CASE WHEN mark_id % 5 = 0 THEN 'annotation' ELSE kind END AS kind,
      CASE WHEN mark_id % 5 = 0 THEN 'changed' ELSE note END AS note
    FROM rd_marks WHERE mark_id % 6 <> 0"""
)

for _fn in (m1_filter_marks, m2_merge_marks, m2_merge_parts, m3_selection_text, m4_pending,
            m5_update_marks):
    QUERIES[_fn.__name__] = _fn

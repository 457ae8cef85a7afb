"""Notes as ordered Markdown blocks.

A note is rows of (book_id, sort key, block), never one string per book; the
text of a note is its blocks in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.operators.pages import heading_line
from pagework.plans.running import block_of, keep_first, running
from pagework.plans.stage import stage

# Labels and callouts of the note format.
TAIL = "## 我的笔记"
CALLOUTS = {"yellow": "warning", "red": "danger", "blue": "info"}
ANNOTATION, HIGHLIGHT, ORIGINAL = "批注", "划线", "*原文：*"
DISCUSSION, CONDENSED = "AI 讨论", "AI 讨论 · 整理"
QUESTION, ANSWER = "问题", "伴读"

LAST = 2_000_000_000


def quoted(c: Column | str) -> Column:
    return F.replace(T.col(c), F.lit("\n"), F.lit("\n> "))


def note_skeleton(outline: DataFrame, titles: DataFrame) -> DataFrame:
    """B1. (book_id, position, line): title, headings except a copy of the
    title, and the tail for the reader's own notes."""
    same = F.lower(F.trim("title")) == F.lower(F.trim("book_title"))
    named = titles.withColumnRenamed("title", "book_title")
    heads = outline.join(named, "book_id").where(~same).select(
        "book_id", F.col("ord").alias("position"), heading_line("level", "title").alias("line")
    )
    top = titles.select(
        "book_id", F.lit(-1).alias("position"), F.concat(F.lit("# "), "title").alias("line")
    )
    tail = titles.select("book_id", F.lit(LAST).alias("position"), F.lit(TAIL).alias("line"))
    return top.unionByName(heads).unionByName(tail)


def missing_headings(outline: DataFrame, note_lines: DataFrame) -> DataFrame:
    """B2. Headings that are not yet lines of the note, in outline order; they
    go right before the tail."""
    heads = outline.select("book_id", "ord", heading_line("level", "title").alias("line"))
    return heads.join(note_lines.select("book_id", "line"), ["book_id", "line"], "left_anti")


def page_label(c: Column | str) -> Column:
    return F.concat(F.lit(" · 第 "), (T.col(c) + 1).cast("string"), F.lit(" 页"))


def mark_block() -> Column:
    """B3. Callout of a mark from its kind, color, page_index, text and note."""
    text = quoted(T.escape_markdown(T.inline("text")))
    callout = F.lit("warning")
    for color, name in CALLOUTS.items():
        callout = F.when(F.col("color") == color, name).otherwise(callout)
    has_note = F.col("note").isNotNull() & (F.col("note") != "")
    annotation = F.concat(
        F.lit(f"> [!success] {ANNOTATION}"), page_label("page_index"),
        F.lit(f"\n> {ORIGINAL} "), text,
        F.when(has_note, F.concat(F.lit("\n>\n> "), quoted("note"))).otherwise(""),
    )
    highlight = F.concat(
        F.lit("> [!"), callout, F.lit(f"] {HIGHLIGHT}"), page_label("page_index"),
        F.lit("\n> "), text,
        F.when(has_note, F.concat(F.lit(f"\n\n> [!note] {ANNOTATION}\n> "), quoted("note"))
               ).otherwise(""),
    )
    return F.when(F.col("kind") == "annotation", annotation).otherwise(highlight)


def conversation_block(turns: DataFrame, pages: DataFrame, collapsed: bool = False) -> DataFrame:
    """B4. (conv_id, turn, block): the callout line with the sorted distinct
    pages (turn -1), then one quoted block per turn.  ``pages`` is (conv_id,
    page_index)."""
    listed = F.array_sort(F.collect_set("page_index"))
    labels = pages.groupBy("conv_id").agg(
        F.array_join(F.transform(listed, lambda p: (p + 1).cast("string")), "、").alias("_pages")
    )
    sign = "-" if collapsed else "+"
    bounds = turns.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    head = bounds.join(labels, "conv_id", "left").select(
        "conv_id",
        F.lit(-1).cast("long").alias("turn"),
        F.concat(
            F.lit(f"> [!example]{sign} {DISCUSSION}"),
            F.when(F.coalesce("_pages", F.lit("")) != "",
                   F.concat(F.lit(" · 第 "), "_pages", F.lit(" 页"))).otherwise(""),
        ).alias("block"),
    )
    label = F.when(F.col("role") == "user", QUESTION).otherwise(ANSWER)
    body = turns.join(bounds, "conv_id").select(
        "conv_id",
        "turn",
        F.concat(
            F.when(F.col("turn") > F.col("_first"), F.lit("> \n")).otherwise(""),
            F.lit("> **"), label, F.lit("：** "), quoted("content"),
        ).alias("block"),
    )
    return head.unionByName(body)


# Fixed value: a heading of a chapter in a note.
HEADING = "^#{2,6}\\s+(.*?)\\s*$"


def _sections(note_lines: DataFrame) -> DataFrame:
    """``note_lines`` with ``owner``, the line number of the heading each line
    belongs to, and ``title``, lower-cased, on headings."""
    title = F.when(F.col("line").rlike(HEADING), F.lower(F.regexp_extract("line", HEADING, 1)))
    return running(
        note_lines.withColumn("title", title), ["book_id"], ["line_no"], block_of("line_no"),
        last={"owner": F.when(F.col("title").isNotNull(), F.col("line_no"))},
    )


def insert_under_chapter(note_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """B5. The note with blocks in place: (book_id, line_no, kind, page_index,
    created_at, block_id, block), to be read in the order of these columns.

    ``note_lines`` is the note as it is (book_id, line_no, line), hand-written
    lines included; every line comes back unchanged (kind 0).  ``blocks`` has
    book_id, chapter, page_index, created_at, block_id, block.  A block (kind 1)
    follows the last line with text below the first heading of its chapter, before
    the next heading.  Without such a heading it follows the heading of the
    reader's own notes, which is added after the last line where there is none.
    """
    lines = stage(_sections(note_lines), "note-lines")
    written = F.when(F.trim("line") != "", F.col("line_no"))
    ends = lines.where("owner IS NOT NULL").groupBy("book_id", F.col("owner").alias("line_no")).agg(
        F.max(written).alias("end"))
    heads = lines.where("title IS NOT NULL").select("book_id", "line_no", "title", "line")
    first = keep_first(heads, ["book_id", "title"], ["line_no"]).join(ends, ["book_id", "line_no"])
    chapters = first.select("book_id", F.col("title").alias("_title"), "end")
    tails = heads.where(F.rtrim("line") == TAIL).groupBy("book_id").agg(F.min("line_no").alias("tail"))
    last = note_lines.groupBy("book_id").agg((F.max("line_no") + 1).alias("after"))
    placed = (
        blocks.withColumn("_title", F.lower(F.trim("chapter")))
        .join(chapters, ["book_id", "_title"], "left")
        .join(tails, "book_id", "left").join(last, "book_id", "left")
        .withColumn("after", F.coalesce("after", F.lit(0)).cast("long"))
    )
    placed = stage(placed, "note-blocks")
    new = placed.select(
        "book_id", F.coalesce("end", "tail", "after").cast("long").alias("line_no"),
        F.lit(1).alias("kind"), "page_index", "created_at", "block_id", "block",
    )
    nothing = [F.lit(None).cast(new.schema[n].dataType).alias(n) for n in ("page_index", "created_at", "block_id")]
    kept = lines.select(
        "book_id", F.col("line_no").cast("long").alias("line_no"), F.lit(0).alias("kind"), *nothing,
        F.col("line").alias("block"))
    added = placed.where("end IS NULL AND tail IS NULL").select("book_id", "after").distinct().select(
        "book_id", F.col("after").alias("line_no"), F.lit(0).alias("kind"), *nothing, F.lit(TAIL).alias("block"))
    return kept.unionByName(added).unionByName(new)


def skip_existing_blocks(blocks: DataFrame, written: DataFrame) -> DataFrame:
    """B6. Blocks whose text the note does not hold yet; digests are compared,
    so no block text is shuffled for the join."""
    return blocks.withColumn("_digest", F.sha2(F.trim("block"), 256)).join(
        written.select("book_id", F.sha2(F.trim("block"), 256).alias("_digest")),
        ["book_id", "_digest"], "left_anti",
    ).drop("_digest")

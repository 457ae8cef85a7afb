"""Rows of boxes, chapter labels and notes, against plain loops."""

import random
import re

from pagework.operators import geometry as G
from pagework.operators import notes as B


def attached_by_hand(texts):
    """Labels join the finished line before them, else the next line."""
    label = re.compile(r"(?i)^(?:chapter\s+[0-9ivxlcdm]+|第\s*[0-9一二三]+\s*章)$")
    paged = re.compile(r"(?:^|[/.:\s])\s*\d{1,4}\s*$")
    out, i = [], 0
    while i < len(texts):
        text = texts[i]
        if label.match(text):
            if out and paged.search(out[-1]):
                out[-1] = f"{text} {out[-1]}"
                i += 1
                continue
            if i + 1 < len(texts) and not label.match(texts[i + 1]):
                text = f"{text} {texts[i + 1]}"
                i += 1
        out.append(text)
        i += 1
    return out


def test_chains_of_labels(spark):
    random.seed(3)
    choices = ["Title 003", "Next title 009", "Bare title", "CHAPTER 01", "CHAPTER IV", "第一章", "第 12 章"]
    pages = [random.choices(choices, k=random.randint(0, 9)) for _ in range(300)]
    pages[0] = ["Title 003", "CHAPTER 01", "CHAPTER 02", "Next title 009"]
    rows = [(0, n, place, text, 0, place, 1, place + 1, 0.5) for n, page in enumerate(pages) for place, text in enumerate(page)]
    lines = spark.createDataFrame(rows, "book_id bigint, page_index int, place int, text string, x0 int, y0 int, x1 int, y1 int, conf double")
    got = {}
    for r in sorted(G.attach_chapter_label(lines).collect(), key=lambda r: (r.page_index, r.place)):
        got.setdefault(r.page_index, []).append(r.text)
    assert got[0] == ["CHAPTER 02 CHAPTER 01 Title 003", "Next title 009"]
    for n, page in enumerate(pages):
        assert got.get(n, []) == attached_by_hand(page), page


def boxes(spark, rows):
    return spark.createDataFrame([(1, 2, *r) for r in rows], "book_id bigint, page_index int, x0 double, y0 double, x1 double, y1 double, text string")


def test_rows_keep_complete_entries_apart(spark):
    rows = [
        (0.06, 0.18, 0.33, 0.22, "第一章 起点"), (0.42, 0.182, 0.45, 0.222, "1"),
        (0.06, 0.29, 0.33, 0.33, "第二章 推进 12"), (0.55, 0.30, 0.82, 0.34, "第四章 结论 39"),
        (0.90, 0.291, 0.94, 0.331, "12"), (0.95, 0.3, 0.97, 0.9, "竖"),
    ]
    got = G.assemble_rows(boxes(spark, rows)).orderBy("row_no").collect()
    assert [r.text for r in got] == ["第一章 起点 1", "第二章 推进 12", "第四章 结论 39", "竖"]
    got = G.assemble_rows(boxes(spark, [rows[2], (0.7, 0.29, 0.74, 0.33, "12")])).collect()
    assert [r.text for r in got] == ["第二章 推进 12"] and got[0].x1 == 0.74


def test_fragments_meet_the_whole_row(spark):
    # The third fragment overlaps what the first two make, but not the second.
    rows = [(0, 0, 50, 20, ""), (51, 7, 90, 14, ""), (52, 8, 99, 26, ""), (300, 0, 310, 20, ""), (5, 5, 5, 9, "")]
    got = sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in G.merge_fragments(boxes(spark, [tuple(map(float, r[:4])) + r[4:] for r in rows])).collect())
    assert got == [(0.0, 0.0, 99.0, 26.0, 3), (300.0, 0.0, 310.0, 20.0, 1)]


def test_written_lines_of_a_note_stay(spark):
    note = ["# Book", "", "## One", "mine", "  ", "### two ", "", B.TAIL, "after"]
    lines = spark.createDataFrame([(1, i, line) for i, line in enumerate(note)] + [(2, 0, "## One")], "book_id bigint, line_no bigint, line string")
    asked = [(1, "one", 3, "t1", 11, "b11"), (1, "One", 2, "t2", 12, "b12"), (1, "Two", 9, "t1", 13, "b13"), (1, "nowhere", 1, "t1", 14, "b14"), (1, None, 0, "t1", 15, "b15"), (2, "none", 5, "t", 16, "b16"), (3, "x", 1, "t", 17, "b17")]
    blocks = spark.createDataFrame(asked, "book_id bigint, chapter string, page_index int, created_at string, block_id bigint, block string")
    rows = B.insert_under_chapter(lines, blocks).collect()
    rows.sort(key=lambda r: (r.book_id, r.line_no, r.kind, r.page_index or 0, r.created_at or "", r.block_id or 0))
    text = {b: [r.block for r in rows if r.book_id == b] for b in (1, 2, 3)}
    assert text[1] == ["# Book", "", "## One", "mine", "b12", "b11", "  ", "### two ", "b13", "", B.TAIL, "b15", "b14", "after"]
    assert text[2] == ["## One", B.TAIL, "b16"] and text[3] == [B.TAIL, "b17"]

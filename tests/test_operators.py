import math
import re

import pytest
from pyspark.sql import functions as F

from pagework.operators import chunks as K
from pagework.operators import geometry as G
from pagework.operators import outline as O
from pagework.operators import pages as P
from pagework.operators import retrieve as Q
from pagework.operators import state as S
from pagework.operators import toc
from pagework.operators import turns as H
from pagework.streaming.streams import transcripts

OUTLINE = "book_id long, ord int, page_index int, level int, title string"


def test_paths_equal_a_stack(spark):
    levels = [0, 2, 1, 1, 3, 0, 1, 2, 5, 2]
    rows = [(1, i, i, lv, f"t{i}") for i, lv in enumerate(levels)]
    got = {r["ord"]: r["path"] for r in O.outline_paths(spark.createDataFrame(rows, OUTLINE)).collect()}
    stack = []
    for i, lv in enumerate(levels):
        stack = stack[: min(lv, len(stack))] + [f"t{i}"]
        assert got[i] == stack


def test_windows_cover_the_text(spark):
    text = "".join(f"Sentence number {i} of the page. " for i in range(400)).strip()
    got = spark.createDataFrame([(text,)], "x string").select(K.windows("x")).first()[0]
    assert all(len(piece) <= 1200 for piece in got)
    assert text.startswith(got[0]) and text.endswith(got[-1])
    at = 0
    for piece in got:
        found = text.find(piece, max(0, at - 200))
        assert 0 <= found <= at
        at = found + len(piece)
    assert at == len(text)


def test_running_heads(spark):
    rows = [(1, i, f"The Book {i}\nbody {chr(97 + i)} text\ntail {chr(97 + i)}q") for i in range(8)]
    pages = spark.createDataFrame(rows, "book_id long, page_index int, text string")
    keys = {r["edge_key"] for r in P.repeated_edge_lines(pages).collect()}
    assert keys == {"the book #"}
    text = P.compact_pages(pages).where("page_index = 2").first()["text"]
    assert text == "body c text tail cq"


def test_rare_concept_wins(spark):
    texts = ["common words here and there", "common words with quaternion inside", "common words again"]
    chunks = spark.createDataFrame(
        [(1, i, i, None, [], t) for i, t in enumerate(texts)],
        "book_id long, chunk_no long, page_index int, chapter_title string, "
        "chapter_path array<string>, text string",
    )
    asks = spark.createDataFrame([(7, 1, "common quaternion")], "query_id long, book_id long, query string")
    best = Q.retrieve(asks, chunks, 2).orderBy("rank").collect()
    assert best[0]["chunk_no"] == 1
    n, df, avg = 3, 1, (5 + 5 + 3) / 3
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    common = math.log(1 + (n - 3 + 0.5) / (3 + 0.5))
    part = 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avg))
    assert best[0]["score"] == pytest.approx((idf + common) * part, abs=1e-6)


def test_silent_question_gets_first_chunks(spark):
    chunks = spark.createDataFrame(
        [(1, i, i, None, [], f"text {i}") for i in range(4)],
        "book_id long, chunk_no long, page_index int, chapter_title string, "
        "chapter_path array<string>, text string",
    )
    asks = spark.createDataFrame([(1, 1, "?!")], "query_id long, book_id long, query string")
    assert [r["chunk_no"] for r in Q.retrieve(asks, chunks, 2).orderBy("rank").collect()] == [0, 1]


def test_contents_parse(spark):
    lines = ["目 录", "第一章 起点 ........ 1", "1.1 背景 / 003", "第二章 方法", "12", "附录 xii"]
    rows = [(1, 0, i, s) for i, s in enumerate(lines)]
    df = spark.createDataFrame(rows, "book_id long, page_index int, line_no int, line string")
    got = [(r["title"], r["printed_page"], r["page_style"]) for r in
           toc.parse_contents(toc.classify(df)).orderBy("ord").collect()]
    assert got == [("第一章 起点", 1, "arabic"), ("1.1 背景", 3, "arabic"),
                   ("第二章 方法", 12, "arabic"), ("附录", 12, "roman")]


def test_vertical_contents_heading(spark):
    rows = [(1, 0, 0, "目 第一章 起点 / 1 9"), (1, 0, 1, "录 第二章 终点 / 25")]
    df = spark.createDataFrame(rows, "book_id long, page_index int, line_no int, line string")
    got = [r["line"] for r in toc.normalize_toc_lines(df).orderBy("line_no", "sub_no").collect()]
    assert got == ["第一章 起点 / 19", "第二章 终点 / 25"]


def test_question_parts(spark):
    df = spark.createDataFrame([("P12\nsome pas-\nsage\n\nWhat is it?",), ("P3\n\nonly",)], "x string")
    a, b = [r[0] for r in df.select(H.parse_question("x")).collect()]
    assert (a["page_number"], a["request"]) == (12, "What is it?")
    assert b["page_number"] is None and b["request"] == "P3\n\nonly"


def test_summary_sections(spark):
    text = "**问题**：为何\n论证：1. 甲 2. 乙 3、丙\n结论：定\n章际关系：承上：据标题"
    df = spark.createDataFrame([(text,)], "x string").select(H.summary_points("x").alias("p"))
    points = [(p["section"], p["point"]) for p in df.first()["p"]]
    assert [s for s, _ in points] == ["问题", "论证", "论证", "论证", "结论"]
    assert df.select(H.summary_complete(F.col("p"))).first()[0]


def test_section_names_inside_points_are_text(spark):
    df = spark.createDataFrame([("结论：问题在于甲\n论证 论证是乙 2. 丙",), ("问题：论证：甲",), ("无",)], "x string")
    got = [[(p["section"], p["point"]) for p in r["p"]] for r in df.select(H.summary_points("x").alias("p")).collect()]
    assert got == [[("结论", "问题在于甲"), ("论证", "论证是乙"), ("论证", "丙")], [("论证", "甲")], []]


def test_lines_of_several_entries(spark):
    lines = ["开始的故事 12 附录", "第一章 甲 1 第二章 乙 9", "目录 第一章 甲 1 第二章 乙 9", "Title one.... 3 Title two.... 9", "A 附录"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select(toc.split_combined("x").alias("p"))
    assert [r["p"] for r in df.collect()] == [
        ["开始的故事 12", "附录"], ["第一章 甲 1", "第二章 乙 9"], ["第一章 甲 1", "第二章 乙 9"],
        ["Title one.... 3", "Title two.... 9"], ["A 附录"]]


def test_vertical_pages_read_right_to_left(spark):
    rows = [(1, 0, f"c{i}", 100 - 20 * i, 50, 110 - 20 * i, 150) for i in range(4)]
    rows.append((1, 0, "head", 10, 5, 110, 15))
    df = spark.createDataFrame(rows, "book_id long, page_index int, text string, x0 int, y0 int, x1 int, y1 int")
    got = [r["text"] for r in G.vertical_order(df).orderBy("place").collect()]
    assert got == ["head", "c0", "c1", "c2", "c3"]


def test_fragments_merge_on_a_line(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 11.0, 1.0, 20.0, 11.0), (1, 0, 40.0, 0.0, 50.0, 10.0),
            (1, 0, 0.0, 30.0, 10.0, 40.0), (1, 0, 0.0, 30.0, 10.0, 40.0)]
    df = spark.createDataFrame(rows, "book_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["x0"], r["y0"], r["x1"], r["n"]) for r in G.merge_fragments(df).collect())
    assert got == [(0.0, 0.0, 20.0, 2), (0.0, 30.0, 10.0, 1), (40.0, 0.0, 50.0, 1)]


def test_manual_outline_survives(spark):
    rows = [(1, True, True, 1, True, 1), (2, True, None, 1, True, 3)]
    df = spark.createDataFrame(
        rows, "book_id long, has_outline boolean, manual_outline boolean, outline_version int, "
        "has_summaries boolean, summary_version int")
    got = {r["book_id"]: (r["has_outline"], r["has_summaries"])
           for r in S.invalidate_derived(df, 2, 3).collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_transcript_joins_pieces(spark):
    said = {
        1: ["hello wor", "world"], 2: ["hello", "hello there"], 3: ["we say", "this"],
        4: ["你好", "世界"], 5: ["a b", "b"], 6: ["one two", "", "two three"],
    }
    rows = [(s, i, True, t) for s, texts in said.items() for i, t in enumerate(texts)]
    rows += [(3, 2, False, "this is"), (3, 2, False, "this is"), (7, 0, False, "only heard"), (8, 0, True, None)]
    frame = spark.createDataFrame(rows[::-1], "session_id bigint, seq bigint, is_final boolean, text string")
    got = {r["session_id"]: r["text"] for r in transcripts(frame).collect()}
    assert got == {1: "hello world", 2: "hello there", 3: "we say this is", 4: "你好世界", 5: "a b",
                   6: "one two three", 7: "only heard", 8: ""}


def test_entries_have_queries_and_sql():
    import __spark_entry__ as entry
    from pagework import catalog

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    # The training-data operators stay outside the catalog.
    assert all(not re.match(r"op\d|pipeline", name) for name in catalog.queries())


def test_hit_boxes_equal_brute_force(spark):
    import random
    import re

    from pagework.operators import geometry

    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "be-ta", "gamma", "al", "pha", "b", "Été"]
    words = []
    for page in range(3):
        for line in range(6):
            for no in range(rng.randint(1, 6)):
                wide = rng.random() < 0.7
                x0, y0 = float(no * 10), float(line * 10)
                words.append((1, page, line, no, rng.choice(vocabulary), x0, y0,
                              x0 + (8.0 if wide else 2.0), y0 + (4.0 if wide else 8.0)))
    asks = [(7, 1, "Beta gamma"), (8, 1, "alpha"), (9, 1, "ete"), (10, 1, "zz"), (11, 2, "alpha")]
    want = []
    lines = {}
    for w in words:
        lines.setdefault(w[:3], []).append(w)
    for query, book, phrase in asks:
        letters = re.sub("[^a-z]", "", phrase.lower())
        pattern = "[^a-z]*".join(letters)
        for (b, page, line), row in lines.items():
            text = " ".join(w[4] for w in row).lower().replace("é", "e")
            for hit in re.finditer(pattern, text) if b == book else ():
                at = 0
                for w in row:
                    low, high, size = max(hit.start(), at), min(hit.end(), at + len(w[4])), len(w[4])
                    if low < at + size and at < hit.end():
                        a, z = (low - at) / size, (high - at) / size
                        x0, y0, x1, y1 = w[5:]
                        if y1 - y0 > (x1 - x0) * 1.25:
                            y0, y1 = y0 + (y1 - y0) * a, y0 + (y1 - y0) * z
                        else:
                            x0, x1 = x0 + (x1 - x0) * a, x0 + (x1 - x0) * z
                        want.append((query, page, line, w[3], hit.start(),
                                     *[round(v, 6) for v in (x0, y0, x1, y1)]))
                    at += size + 1
    table = spark.createDataFrame(
        words, "book_id long, page_index int, line_no int, word_no int, text string, "
        "x0 double, y0 double, x1 double, y1 double")
    asked = spark.createDataFrame(asks, "query_id long, book_id long, phrase string")
    got = geometry.search_hit_boxes(asked, table).select(
        "query_id", "page_index", "line_no", "word_no", "start", "x0", "y0", "x1", "y1").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)

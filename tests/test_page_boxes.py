"""Boxes of a page meet in the page's row: the same as by plain loops, without a shuffle."""

import random

import pyarrow as pa
import pytest

from pagework.catalog import geometry as C
from pagework.operators import geometry as G
from pagework.operators import pageboxes as P
from pagework.sources import derived as D


@pytest.fixture
def book(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", None, " ".join(["word"] * 400)]
    texts += ["\n".join(" ".join(rng.choices(["a", "Été", "longer", "12"], k=rng.randint(0, 200))) for _ in range(5)) for _ in range(9)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def plan(df):
    """The plan above the pages, which small inputs are spread to."""
    return df._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "")


def merged_by_hand(boxes):
    rows, seen = [], set()
    for y0, x0, y1, x1 in sorted((b[1], b[0], b[3], b[2]) for b in boxes if b[2] > b[0] and b[3] > b[1]):
        quarters = tuple(int((v * 4 + 0.5) // 1) for v in (y0, x0, y1, x1))
        if quarters in seen:
            continue
        seen.add(quarters)
        for r in rows:
            least = min(r[2] - r[0], y1 - y0)
            if r[2] > y0 and min(r[2], y1) - max(r[0], y0) >= 0.62 * max(least, 0.001) and (
                    max(r[1], x0) - min(r[3], x1) <= max(2.0, 0.22 * least)):
                r[:] = [min(r[0], y0), min(r[1], x0), max(r[2], y1), max(r[3], x1), r[4] + 1]
                break
        else:
            rows.append([y0, x0, y1, x1, 1])
    return sorted((left, top, right, low, n) for top, left, low, right, n in rows)


def test_fragments_of_pages_equal_plain_loops(spark, book):
    rng = random.Random(6)
    pages = {n: [] for n in range(30)}
    for n, boxes in pages.items():
        for _ in range(rng.randint(1, 80)):
            x, y = rng.uniform(-9, 300), rng.uniform(-9, rng.choice([40, 400]))
            boxes.append((x, y, x + rng.uniform(-1, rng.choice([9, 90])), y + rng.uniform(0, 25)))
        boxes += [tuple(v + 0.01 for v in b) for b in boxes[:5]]
    rows = [(1, n, *b) for n, boxes in pages.items() for b in boxes]
    rects = spark.createDataFrame(rows, "book_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    got = {n: [] for n in pages}
    for r in G.merge_fragments(rects).collect():
        got[r.page_index].append((r.x0, r.y0, r.x1, r.y1, r.n))
    assert {n: sorted(rows) for n, rows in got.items()} == {n: merged_by_hand(b) for n, b in pages.items()}
    merged = C.g10_merge_fragments(spark, book)
    assert "hashpartitioning(book_id" not in plan(merged)
    shifted = {}
    for w in C.words(spark, book).collect():
        step = w.word_no % 3 * 2
        shifted.setdefault(w.page_index, set()).add((w.x0, w.y0 + step, w.x1, w.y1 + step))
    want = sorted((n, *r) for n, boxes in shifted.items() for r in merged_by_hand(boxes))
    assert want and sorted((r.page_index, r.x0, r.y0, r.x1, r.y1, r.n) for r in merged.collect()) == want


def deduped_by_hand(boxes):
    """Boxes are (key, text, x0, y0, x1, y1, conf)."""

    def lost(a, b):
        wide, high = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        least = min((a[4] - a[2]) * (a[5] - a[3]), (b[4] - b[2]) * (b[5] - b[3]))
        return wide > 0 and high > 0 and wide * high / least >= 0.72 and (a[1] in b[1] or b[1] in a[1]) and (
            -b[6], -len(b[1]), b[0]) < (-a[6], -len(a[1]), a[0])

    return sorted(a[0] for a in boxes if not any(lost(a, b) for b in boxes))


def test_copies_of_pages_equal_plain_loops(spark, book):
    rng = random.Random(8)
    pages = {}
    for n in range(30):
        boxes = pages[n] = []
        for k in range(rng.randint(1, 60)):
            x, y = (rng.uniform(0, 60) if rng.random() < 0.5 or not boxes else boxes[-1][i] + rng.uniform(0, 2) for i in (2, 3))
            text = rng.choice(["a", "ab", "Été", "abé", ""])
            boxes.append((k, text, x, y, x + rng.choice([6, 20, 900]), y + rng.choice([5, 9, 700]), rng.randint(1, 4)))
    rows = [(1, n, *b) for n, boxes in pages.items() for b in boxes]
    df = spark.createDataFrame(rows, "book_id long, page_index int, no long, text string, x0 double, y0 double, x1 double, y1 double, conf int")
    got = {n: [] for n in pages}
    kept = G.dedupe_boxes(df, ["no"])
    assert kept.columns == df.columns
    for r in kept.collect():
        got[r.page_index].append(r.no)
    assert {n: sorted(k) for n, k in got.items()} == {n: deduped_by_hand(b) for n, b in pages.items()}
    stay = C.g3_dedupe_boxes(spark, book)
    assert "hashpartitioning(book_id" not in plan(stay)
    words = {}
    for w in C.words(spark, book).collect():
        words.setdefault(w.page_index, []).append(((w.line_no, w.word_no, w.dup), w.text, w.x0, w.y0, w.x1, w.y1, w.conf))
    want = sorted((n, *key) for n, boxes in words.items() for key in deduped_by_hand(boxes))
    assert want and sorted((r.page_index, r.line_no, r.word_no, r.dup) for r in stay.collect()) == want


def test_columns_of_pages_equal_plain_loops(spark, book):
    placed = C.g6_column_order(spark, book)
    assert "hashpartitioning(book_id" not in plan(placed)
    pages = {}
    for w in C.single(spark, book).collect():
        odd = w.line_no % 2
        pages.setdefault(w.page_index, []).append(
            (w.y0 - 51 * odd, w.x0 // 2 + 1200 * odd, w.x1 // 2 + 1200 * odd, w.text, w.y1 - 51 * odd))
    want = []
    for page, boxes in pages.items():
        rows = []
        for b in sorted(boxes):
            if not rows or b[0] - rows[-1][-1][0] > 0.55 * max(b[4] - b[0], rows[-1][-1][4] - rows[-1][-1][0]):
                rows.append([])
            rows[-1].append(b)
        parts = []
        for row in rows:
            high, reach = row[0][4] - row[0][0], None
            for b in sorted(row, key=lambda b: b[1:4]):
                if reach is None or b[1] - reach > max(9, high * 1.35):
                    parts.append([])
                parts[-1].append(b)
                reach = max(b[2], reach or b[2])
        lines = [(min(b[0] for b in p), p[0][1], max(b[2] for b in p), " ".join(b[3] for b in p)) for p in parts]
        narrow = [r for r in lines if r[2] - r[1] < 1392]
        left, right = ([r[0] for r in narrow if (r[1] + r[2] < 2400) == side] for side in (True, False))
        two = len(left) >= 5 and len(right) >= 5 and min(max(left), max(right)) > max(min(left), min(right))
        top = min((r[0] for r in narrow), default=0)

        def column(r, two=two, top=top):
            if not two:
                return 0
            if r[2] - r[1] < 1392:
                return 1 if r[1] + r[2] < 2400 else 2
            return 0 if r[0] <= top + max(8, abs(top) * 0.01) else 3

        in_order = sorted((column(r), *r) for r in lines)
        want += [(page, n, r[0], r[2], r[1]) for n, r in enumerate(in_order, 1)]
    got = [(r.page_index, r.place, r.column_no, r.x0, r.y0) for r in placed.collect()]
    assert want and sorted(got) == sorted(want)


def test_two_columns_with_header_and_footer(spark):
    rows = [(1, 0, f"l{i}", 0, 100 + 20 * i, 400, 110 + 20 * i) for i in range(5)]
    rows += [(1, 0, f"r{i}", 600, 100 + 20 * i, 990, 110 + 20 * i) for i in range(5)]
    rows += [(1, 0, "head", 0, 9, 990, 20), (1, 0, "foot", 0, 900, 990, 910), (2, 7, "b", 0, 20, 5, 30), (2, 7, "a", 0, 10, 5, 20)]
    lines = spark.createDataFrame(rows, "book_id long, page_index int, text string, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r.book_id, r.place, r.text, r.column_no) for r in G.column_order(lines, 1000.0).collect())
    assert [r[2] for r in got if r[0] == 1] == ["head", *[f"l{i}" for i in range(5)], *[f"r{i}" for i in range(5)], "foot"]
    assert [r[2:] for r in got if r[0] == 2] == [("a", 0), ("b", 0)]


def test_page_numbers_are_read_as_by_the_pattern(spark):
    texts = ["a 12", "12", "a12", "+1 (415)", "+44  【7】 ", "x (7)", "x（ 0012 ）", "a/3", "a…9\t", "12345", "a 1 2", "a 12 ", "(3", "第 4页", "", "+1 415"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.F.regexp_extract("t", G.TRAILING_PAGE, 1).alias("p"))
    assert [(r.t, r.p or None) for r in df.collect()] == [(t, P.trailing_page(t)) for t in texts]


def rows_by_hand(boxes):
    """The fold over every member of every row."""
    rows, out = [], []
    for y0, y1, complete in boxes:
        best = None
        for n, row in enumerate(rows):
            if max(b[1] for b in row) <= y0 or complete and any(b[2] for b in row):
                continue
            apart = [abs(b[0] + b[1] - y0 - y1) / 2 for b in row]
            near = any(
                min(b[1], y1) - max(b[0], y0) >= 0.42 * max(min(b[1] - b[0], y1 - y0), 1e-6)
                or a <= 0.42 * max(b[1] - b[0], y1 - y0) for a, b in zip(apart, row, strict=True))
            if near and (best is None or min(apart) > best[0]):
                best = (min(apart), n)
        if best is None:
            rows.append([])
        out.append(len(rows) - 1 if best is None else best[1])
        rows[out[-1]].append((y0, y1, complete))
    return out


def test_rows_of_pages_equal_plain_loops(spark, book):
    rng = random.Random(9)
    for _ in range(400):
        heights = [(y, y + rng.randint(1, 25)) for y in rng.choices(range(60), k=rng.choice([2, 9]))]
        boxes = sorted(((*rng.choice(heights), rng.random() < 0.2) for _ in range(40)), key=lambda b: b[0])
        assert P.rows_of_pieces(boxes) == rows_by_hand(boxes)
    lines = C.g4_assemble_rows(spark, book)
    assert "hashpartitioning(book_id" not in plan(lines)
    boxes = C.slanted(D.placed_words(pa.array(["one two\nthree", None, "x"]), False)).to_pylist()
    assert [[(b["text"], b["y0"]) for b in page] for page in boxes] == [[("one", 40), ("two", 42), ("three", 91)], [], [("x", 40)]]
    heights = {(r.page_index, r.y0, r.y1) for r in lines.collect()}
    assert (2, 40, 60) in heights


def test_words_are_placed_in_lines_that_are_hit(spark, book):
    found = C.g11_search_hit_boxes(spark, book)
    physical = plan(found)
    assert "Window" not in physical and "word_no" not in "".join(x for x in physical.splitlines() if "hashpartitioning(book_id" in x and "line_no" in x)
    flat = G.search_hit_boxes(C.CS.asked(spark, book), C.single(spark, book))
    got = sorted(map(tuple, found.collect()))
    assert got and len({r[3] for r in got}) > 1 and got == sorted(map(tuple, flat.select(*found.columns).collect()))

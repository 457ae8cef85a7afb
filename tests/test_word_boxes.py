"""Word boxes are placed inside their line's row."""

from pagework.operators import geometry as G
from pagework.sources import derived as D


def test_words_are_placed_without_a_shuffle(spark, tmp_path):
    texts = ["One  two\n longer  words here ", "", None, "x " * 300]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    words = D.words(spark, str(tmp_path))
    assert "Window" not in words._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            off = 0
            for k, word in enumerate(line.split(" ")):
                if word:
                    x, y = 40 + off % 220 * 10, 40 + (n * 3 + off // 220) * 17
                    want.add((i, n, k, word, x, y, x + len(word) * 10, 0))
                    if k % 9 == 0 and len(word) > 2:
                        want.add((i, n, k, word[:-1], x, y, x - 10 + len(word) * 10, 1))
                    off += len(word) + 1
    got = [(r.page_index, r.line_no, r.word_no, r.text, r.x0, r.y0, r.x1, r.dup) for r in words.collect()]
    assert set(got) == want and len(got) == len(want)


def test_fragments_are_shuffled_once(spark):
    rows = [(1, 2, 0.0, 0.0, 5.0, 10.0), (1, 2, 0.1, 0.0, 5.0, 10.0), (1, 2, 6.0, 1.0, 9.0, 10.0), (1, 2, 40.0, 0.0, 50.0, 10.0), (1, 2, 3.0, 3.0, 3.0, 9.0)]
    rects = spark.createDataFrame(rows, "book_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    merged = G.merge_fragments(rects)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in merged.collect()) == [(0.0, 0.0, 9.0, 10.0, 2), (40.0, 0.0, 50.0, 10.0, 1)]

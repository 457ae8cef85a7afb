"""Numbers in brackets at the end of a line: pages, unless they are area codes."""

from pagework.operators import geometry as G


def test_area_codes_are_no_pages(spark):
    lines = ["Chapter 8 Of erndwh +1 (607)", "Title (12)", "Title +1 13"]
    rows = [(1, 3, "down", i, t) for i, t in enumerate(lines)]
    orders = spark.createDataFrame(rows, "book_id long, page_index int, tag string, place int, text string")
    assert [r.score for r in G.best_layout(orders).collect()] == [18.0]
    boxes = spark.createDataFrame([(t,) for t in lines], "text string").select(G.F.col("text").rlike(G.TRAILING_PAGE).alias("paged"))
    assert [r.paged for r in boxes.collect()] == [False, True, True]

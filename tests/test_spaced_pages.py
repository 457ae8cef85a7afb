"""Spaced page numbers next to digits of the title."""

from pagework.operators import toc


def test_wide_gaps_part_title_and_page(spark):
    cases = {"queelletre +1  3 1": "queelletre +1  31", "Title 1 2 3": "Title 123", "Title  1  2  3": "Title  123", "a 2  1 0 4": "a 2  104"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", toc.join_trailing_digits("t").alias("j"))
    assert {r.t: r.j for r in df.collect()} == cases

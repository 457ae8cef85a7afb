"""Numbers that are no place in an outline: card numbers, digits without end."""

from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.operators import toc


def test_sequence_keys_of_long_numbers(spark):
    rows = [("4763047826333361 Of",), ("1." + "9" * 30 + " Of",), ("2.1 Of",)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t"), T.sequence_key("t").alias("k"))
    assert [r.k for r in df.collect()] == [[4763047826333361], None, [2, 1]]


def test_linewise_entries_keep_long_numbers(spark):
    lines = ["1 First title  3", "4763047826333361 Of thnd  5", f"{'9' * 30} Of other  7", "2 Second title  9"]
    df = spark.createDataFrame([(1, 3, i, t) for i, t in enumerate(lines)], "book_id long, page_index int, line_no int, line string")
    got = [(r.title, r.printed_page) for r in toc.parse_linewise(df).orderBy("ord").collect()]
    assert got == [("1 First title", 3), ("4763047826333361 Of thnd", 5), ("9" * 30 + " Of other", 7), ("2 Second title", 9)]

"""Addresses inside titles are text, no entry, point or level of their own."""

from pyspark.sql import functions as F

from pagework.operators import toc
from pagework.operators import turns as H


def test_addresses_do_not_split_lines(spark):
    cases = {
        "7.1.1 Erorly of, 23.184.127.85 oneain  31 Chapter 8 Elle": ["7.1.1 Erorly of, 23.184.127.85 oneain  31", "Chapter 8 Elle"],
        "10.1 56.187.231.175 Keit / 046": ["10.1 56.187.231.175 Keit / 046"],
        "1.1.1.1 One / 3 1.1.1.2 Two / 5": ["1.1.1.1 One / 3", "1.1.1.2 Two / 5"],
        "Chapter 9 Í. Mi osado ........ 41": ["Chapter 9 Í. Mi osado ........ 41"],
        "Foreword .. iv Preface ... vi": ["Foreword .. iv", "Preface ... vi"],
        "1.1 One 3 1.2 Two 5": ["1.1 One 3", "1.2 Two 5"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", toc.split_combined("t").alias("p"))
    assert {r.t: r.p for r in df.collect()} == cases


def test_addresses_change_no_level(spark):
    lines = ["10.1 56.187.231.175 Keit in lich / 046", "2.1.1 Other  47"]
    df = spark.createDataFrame([(1, 3, i, t) for i, t in enumerate(lines)], "book_id long, page_index int, line_no int, line string")
    got = toc.parse_contents(toc.classify(df)).orderBy("ord").collect()
    assert [(r.title, r.level) for r in got] == [("10.156.187.231.175 Keit in lich", 1), ("2.1.1 Other", 2)]


def test_addresses_are_no_points(spark):
    text = "问题：See 23.184.127.85 there\n论证：1. One 2. At 10.0.0.1 too 3) Three"
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(H.summary_points("t")).alias("p"))
    assert [r.p.point for r in df.collect()] == ["See 23.184.127.85 there", "One", "At 10.0.0.1 too", "Three"]

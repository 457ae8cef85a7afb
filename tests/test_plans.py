import random

import pytest
from pyspark.sql import functions as F

from pagework.plans import containment
from pagework.plans.running import block_of, running


def test_split_groups_give_the_same_running_values(spark):
    rng = random.Random(5)
    rows = [(b, i, rng.choice([None, i]), rng.randint(0, 9)) for b in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "book_id long, ord int, v int, w int")
    for reverse in (False, True):
        for inclusive in (False, True):
            out = []
            for size in (16, 1000):
                got = running(
                    df, ["book_id"], ["ord"], block_of("ord", size),
                    last={"l": F.col("v")}, total={"t": F.col("w")},
                    low={"lo": F.col("w")}, high={"hi": F.col("w")},
                    reverse=reverse, inclusive=inclusive,
                )
                out.append(sorted(map(tuple, got.collect()), key=lambda r: r[:2]))
            assert out[0] == out[1]


@pytest.mark.parametrize("looked_up,at_once", [(256, 1024), (0, 7)])
def test_containment_equals_brute_force(spark, monkeypatch, looked_up, at_once):
    """Needles searched one by one, and by grams with needles and texts in blocks."""
    monkeypatch.setattr(containment, "LOOKED_UP", looked_up)
    monkeypatch.setattr(containment, "TEXTS_AT_ONCE", at_once)
    monkeypatch.setattr(containment, "NEEDLES_AT_ONCE", max(4, at_once))
    rng = random.Random(7)
    words = ["ab", "abc", "bca", "学习", "c a", "longer word", "x"]
    texts = [(k, i, " ".join(rng.choice(words) for _ in range(12))) for k in (0, 1, 2) for i in range(30)]
    texts += [(0, 100, None), (1, 100, ""), (None, 101, "ab")]
    needles = [(k, n) for k in (0, 1) for n in
               ["a", "ab", "bca ab", "学习", "longer word ab", "zz", "word", "abcbca", " ab", "", None]]
    t = spark.createDataFrame(texts, "k int, id int, text string")
    n = spark.createDataFrame(needles + needles[:3], "k int, needle string")
    size = lambda held, text: F.transform(
        held, lambda x: F.struct(x.alias("needle"), F.length(text).alias("size")))
    rows = containment.contains_pairs(n, t, ["k"], ["id"], result=size).collect()
    got = sorted((r["k"], r["needle"], r["id"], r["size"]) for r in rows)
    want = sorted((k, s, i, len(x)) for k, i, x in texts for k2, s in needles
                  if k == k2 and s and x and s in x)
    assert got == want


def test_no_text_leaves_the_row_it_is_searched_in(spark):
    t = spark.createDataFrame([(1, 1, "some text")], "k int, id int, text string")
    n = spark.createDataFrame([(1, "text")], "k int, needle string")
    plan = containment.contains_pairs(n, t, ["k"], ["id"])
    plan = plan.groupBy("needle").count()._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode")]
    assert "Exchange" in above and "text#" not in above


def test_no_all_pairs_plans(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    for name in ("q2_bm25_retrieve", "o2_chapter_for_page", "f1_match_ranges", "g3_dedupe_boxes"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

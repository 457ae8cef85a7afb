"""Work of title candidates, sentence hits and tokens: what is looked at and shuffled."""

import re

from pyspark.sql import functions as F

from pagework.catalog import text as C
from pagework.functions import text as T
from pagework.operators import resolve as R
from pagework.operators import search as S


def test_guards_leave_no_character_out():
    for letters, guard in ((set(T.COMPATIBLE) | set(T.WIDE_BLANKS) - {" "} | set(T.LIGATURES), T.COMPATIBLE_CLASS),
                           (set(T.FOLDED), T.ACCENTED_CLASS), (set("​⁠" + T.CJK_PUNCT), T.WIDE_CLASS)):
        known = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), guard))
        assert [c for c in letters if not known.match(c)] == []


def test_normalized_text_of_guarded_kinds(spark):
    texts = ["a\u200bb", "ｆｕｌｌ wide", "co-\nop  x\t y", "a\n\n\n\nb.\n\n c", "É…ﬁ", "no mark", "中 文", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select(
        "i", T.normalize_text("x").alias("n"), T.search_projection("x").alias("p")).orderBy("i").collect()
    assert [r["n"] for r in got] == ["ab", "full wide", "coop x y", "a b.\nc", "É...fi", "no mark", "中文", None]
    assert [r["p"] for r in got] == ["ab", "fullwide", "coopxy", "abc", "efi", "nomark", "中文", None]


def test_bigrams_of_characters_beyond_the_plane(spark):
    keys = ["", "a", "ab", "abab", "a𠀀b𠀁"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(R.bigrams(F.col("k"))).collect()
    assert [r[0] for r in got] == [[""], ["a"], ["ab"], ["ab", "ba"], ["a𠀀", "𠀀b", "b𠀁"]]


def test_bigrams_beyond_the_compared_part_make_no_pair(spark):
    needles = spark.createDataFrame([(1, "quartz")], "book_id long, needle string")
    heads = spark.createDataFrame(
        [(1, 0, "a" * 300 + "quartz"), (1, 1, "quartz" + "a" * 300)], "book_id long, page_index int, head string")
    got = R.similar_pairs(needles, heads).collect()
    assert [r["page_index"] for r in got] == [1]


def test_sentences_stay_in_their_page(spark):
    text = "One fish. Two\x01fish! twofish.  Three cats? O\u00c9 two - fish"
    pages = spark.createDataFrame([(1, 0, text), (1, 1, ""), (1, 2, None), (2, 0, "two fish.")],
                                  "book_id long, page_index int, text string")
    assert S.sentences(pages).where("book_id = 1").count() == 3
    asks = spark.createDataFrame([(7, 1, "Two fish"), (8, 1, "fish two"), (9, 1, "oe"), (10, 1, "?")],
                                 "query_id long, book_id long, phrase string")
    got = S.sentence_hits(asks, pages).orderBy("query_id", "sentence_no").collect()
    assert [(r["query_id"], r["sentence_no"], r["sentence"]) for r in got] == [
        (7, 1, "Two\x01fish!"), (7, 2, "twofish."), (7, 4, "O\u00c9 two - fish"), (9, 4, "O\u00c9 two - fish")]


def test_tokens_are_not_shuffled(spark):
    plan = C.n8_tokenize(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not any("token" in d for d in dealt)

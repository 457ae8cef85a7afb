from pyspark.sql import functions as F

from pagework.functions import text as T


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first()["y"]


def test_cjk_blanks_go(spark):
    assert one(spark, T.normalize_text, "中 文 字。\n下") == "中文字。下"
    assert one(spark, T.remove_spurious_spaces, "第 3 章 导 论") == "第3章导论"


def test_letter_runs_join(spark):
    assert one(spark, T.remove_spurious_spaces, "the r e  p o r t is a b") == "the report is a b"
    assert one(spark, T.inline, "r e p o r t") == "report"
    long_run = " ".join("a" * 20000)
    assert one(spark, T.remove_spurious_spaces, long_run) == "a" * 20000


def test_inline_joins_wrapped_words(spark):
    assert one(spark, T.inline, "exam-\nple of\ntext") == "example of text"
    assert one(spark, T.inline, "中文\n换行") == "中文换行"


def test_tokens_have_han_pairs(spark):
    assert one(spark, T.tokens, "Deep 学习, a") == ["deep", "学习", "学", "习", "学习"]


def test_token_estimate(spark):
    assert one(spark, T.estimated_tokens, "") == 0
    assert one(spark, T.estimated_tokens, "a") == 1
    assert one(spark, T.estimated_tokens, "学习 reading.") == 5


def test_printed_pages(spark):
    def page(value):
        fn = lambda c: T.printed_page(T.page_label_token(c))
        got = one(spark, fn, value)
        return got and (got["value"], got["style"])

    assert page("xiv") == (14, "roman")
    assert page("第19页") == (19, "arabic")
    assert page("正文-1") == (1, "arabic")
    assert page("p. 007") == (7, "arabic")
    assert page("0") is None and page("word") is None


def test_sequence_keys(spark):
    assert one(spark, T.sequence_key, "1.2.3 Title") == [1, 2, 3]
    assert one(spark, T.sequence_key, "第二十三章 题") == [23]
    assert one(spark, T.sequence_key, "Chapter 12 x") == [12]
    assert one(spark, T.sequence_key, "Plain") is None


def test_broken_glyphs(spark):
    assert one(spark, T.needs_ocr_correction, "a�")
    assert not one(spark, T.needs_ocr_correction, "fine")


def test_accept_correction(spark):
    df = spark.createDataFrame([("reading", "readlng"), ("reading", "other thing")], "a string, b string")
    assert [r[0] for r in df.select(T.accept_correction("a", "b")).collect()] == ["readlng", None]


def test_search_projection_ignores_accents_and_blanks(spark):
    assert one(spark, T.search_projection, "Él  É-té!") == "elete"


def test_projection_folds_any_accent_and_compatibility_form(spark):
    texts = ["český ő ř", "Tiế́ng Việt", "élève", "Ⅳ ⅷ", "ｶﾅ ①", "ﬁne eﬃcient", "Ｆｕｌｌ"]
    want = ["ceskyor", "tiengviet", "eleve", "ivviii", "カナ1", "fineefficient", "full"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.p for r in df.select("i", T.search_projection("t").alias("p")).orderBy("i").collect()]
    assert got == want


def test_hits_inside_ligatures_and_accents_have_ranges(spark):
    from pagework.operators import search as S

    lines = ["the ﬁne art of x.", "an eﬃ- cient ﬂow", "Šťastný  nový rok", "café noir"]
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(lines)], "book_id long, page_index int, line_no int, line string")
    asks = spark.createDataFrame(
        [(1, 1, "fine art"), (2, 1, "efficient flow"), (3, 1, "stastny novy"), (4, 1, "CAFÉ NOIR"), (5, 1, "ine art")],
        "query_id long, book_id long, phrase string",
    )
    got = {r.query_id: lines[r.line_no][r.start : r.stop] for r in S.match_ranges(asks, df).collect()}
    assert got == {1: "ﬁne art", 2: "eﬃ- cient ﬂow", 3: "Šťastný  nový", 4: "café noir", 5: lines[0]}

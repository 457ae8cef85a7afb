"""The word table of an OCR run: packed on disk, and words that need no clean-up."""

import glob
import random

from pagework.catalog import geometry as C
from pagework.functions import text as T
from pagework.sources import store


def test_word_table_is_packed(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(0, "One two\nthree " + "word " * 40, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(store, "new_folder", lambda spark, label: str(tmp_path / label))
    rows = C.s2_ocr_lines(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and glob.glob(f"{tmp_path}/tsv/*.csv.gz") and not glob.glob(f"{tmp_path}/tsv/*.csv")


def test_visible_words_stay_as_they_are(spark):
    rng = random.Random(2)
    words = ["".join(chr(rng.randint(33, 126)) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    got = df.select("text", T.single_spaced(T.normalize_text("text")).alias("t")).collect()
    assert [r.t for r in got] == [r.text for r in got]
    odd = ["a b", "x\n", "ﬁ", "Ａ", " a"]
    rows = [(5, 1, 1, 1, 1, i, float(i), 0.0, 1.0, 1.0, 90.0, w) for i, w in enumerate(odd)]
    table = spark.createDataFrame(rows, store.TSV)
    want = " ".join(r.t for r in spark.createDataFrame([(w,) for w in odd], "text string").select(T.single_spaced(T.normalize_text("text")).alias("t")).collect())
    assert [r.text for r in store.ocr_lines(table, ["page_num"]).collect()] == [want]

"""Queries next to their comparison SQL on headings and lines that the given tables hold rarely."""

import duckdb

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    frame = entry.queries()[name](spark, str(folder))
    got = sorted(map(repr, map(tuple, frame.collect())))
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return got, sorted(map(repr, want))


DOCUMENTS = "doc_id bigint, text string, lang string, source string"


def test_quoted_headings_too_short_to_be_placed(spark, tmp_path):
    titles = {4: "A first chapter begins", 9: "!!! ??? ---", 14: "ab", 19: "é à", 24: "Four more words here", 29: "— x —", 34: "abcd", 39: "", 44: "12"}
    docs = [(i, titles.get(i % 50, "Some other page") + f"\nwith text of its own {i}", "en", "web") for i in range(100)]
    turns = []
    for conv in range(60):
        for turn in range(8):
            turns.append((conv, turn, "user" if turn % 2 == 0 else "assistant", f"why is it so {conv} {turn}"))
    tables = {"documents": (docs, DOCUMENTS), "conversations": (turns, "conv_id bigint, turn int, role string, text string")}
    for name in ("h5_note_groups", "h5_group_pages"):
        folder = tmp_path / name
        folder.mkdir()
        got, want = both(spark, folder, name, **tables)
        assert got == want


def test_corrections_of_accented_lines(spark, tmp_path):
    lines = ["né ma en", "aa é aa bb aa", "ressasser été", "éta été ate", "xéà abcba y", "Ü, Ü, Ü,", "ça ac", "le mot ûn", "abé eba", "kayàk"]
    docs = [(3 * i, line, "fr", "web") for i, line in enumerate(lines)]
    labels = [(3 * i, 1, 0) for i in range(len(lines))]
    got, want = both(spark, tmp_path, "n13_accept_correction", documents=(docs, DOCUMENTS),
                     labels=(labels, "doc_id bigint, quality int, toxic int"))
    assert got == want

"""Full-text search over pages.

``asks`` has query_id, book_id and phrase; matches ignore case, accents, blanks
and punctuation, on the projection N5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.operators import retrieve as Q
from pagework.plans.containment import contains_pairs
from pagework.plans.running import keep_first, top_rows
from pagework.plans.stage import stage

GAP = "[^\\p{L}\\p{N}]*"
APART = "\x01"
BOUNDARY = ".。!?！？；;"
LETTERS = {c: t for c, t in T.LIGATURES.items() if "\ufb00" <= c <= "\ufb06"}


def needles(asks: DataFrame) -> DataFrame:
    return asks.select(
        "query_id", "book_id", T.search_projection("phrase").alias("needle")
    ).where("needle <> ''")


def matching_rows(asks: DataFrame, texts: DataFrame, text_id: list[str],
                  result: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, book_id, text_id, needle) where the projection of the text
    contains the projection of the phrase.  ``texts`` has book_id, text_id, text.
    ``result`` adds columns that are computed in the text's own row."""
    wanted = needles(asks)
    raw = texts.select("book_id", *text_id, "text")
    pairs = contains_pairs(wanted, raw, ["book_id"], text_id, T.search_projection, result)
    return pairs.join(wanted, ["book_id", "needle"])


def needle_pattern(needle: Column) -> Column:
    """The needle with anything but letters and digits allowed in between; a
    match in the folded text is then a match of the projections, in place.
    Letters that a ligature may stand for match it as well."""
    plain = F.array_join(F.split(needle, "(?<=.)(?=.)"), GAP)
    pattern = plain
    spelled = sorted(LETTERS.items(), key=lambda e: (-len(e[1]), e[0]))
    for text in dict.fromkeys(t for _, t in spelled):
        forms = {f for c, t in spelled for f in _forms(text, c, t)}
        apart = GAP.join(text)
        either = "(?:" + "|".join([apart, *sorted(forms)]) + ")"
        pattern = F.replace(pattern, F.lit(apart), F.lit(either))
    return F.when(needle.rlike("|".join(dict.fromkeys(LETTERS.values()))), pattern).otherwise(plain)


def _forms(text: str, ligature: str, spelling: str) -> set[str]:
    """``text`` with one occurrence of a ligature's spelling written by it."""
    found = {i for i in range(len(text)) if text.startswith(spelling, i)}
    return {GAP.join([*text[:i], ligature, *text[i + len(spelling):]]) for i in found}


def ranges_or_all(folded: Column, pattern: Column) -> Column:
    """``ranges_in``; the whole text where a match has no range of its own,
    as one that begins or ends inside a ligature or a Roman numeral."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(folded).alias("stop")))
    return T.bound(ranges_in(folded, pattern), lambda r: F.when(F.size(r) > 0, r).otherwise(whole))


def ranges_in(folded: Column, pattern: Column) -> Column:
    """All non-overlapping [start, stop) positions, from the lengths of the
    matches and of the pieces between them."""
    pieces = F.transform(F.split(folded, pattern), lambda p: F.length(p))
    found = F.transform(F.regexp_extract_all(folded, pattern, F.lit(0)), lambda m: F.length(m))
    start = F.struct(
        F.lit(0).alias("at"),
        F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("out"),
    )

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + pair["p"]
        last = first + pair["m"]
        return F.struct(
            last.alias("at"),
            F.array_append(
                state["out"], F.struct(first.alias("start"), last.alias("stop"))
            ).alias("out"),
        )

    pairs = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(found)), found,
        lambda p, m: F.struct(p.alias("p"), m.alias("m")),
    )
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def ranges_of(held: Column, _searched: Column) -> Column:
    """Per held needle its ranges in the row's ``text``, which is folded once."""
    return T.bound(T.fold("text"), lambda folded: F.transform(held, lambda n: F.struct(
        n.alias("needle"), ranges_or_all(folded, needle_pattern(n)).alias("ranges"))))


def match_ranges(asks: DataFrame, lines: DataFrame) -> DataFrame:
    """F1. (query_id, book_id, page_index, line_no, start, stop), 0-based."""
    key = ["page_index", "line_no"]
    hits = matching_rows(asks, lines.withColumnRenamed("line", "text"), key, ranges_of)
    placed = hits.select("query_id", "book_id", *key, F.explode("ranges").alias("r"))
    return placed.select("query_id", "book_id", *key, "r.start", "r.stop")


def sentences(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, text): the sentences of a page as an array."""
    normal = T.normalize_text("text")
    return pages.select(
        "book_id", "page_index", F.split(normal, "(?<=[。！？.!?])\\s*").alias("text"))


def projections(sentences: Column | str) -> Column:
    """The projections of a page's sentences, made at once and kept apart by a
    character that no needle has."""
    apart = F.transform(T.col(sentences), lambda s: F.replace(s, F.lit(APART), F.lit(" ")))
    folded = T.fold(T.nfkc(F.array_join(apart, APART)))
    return F.regexp_replace(folded, "[^\\p{L}\\p{N}\\x01]", "")


def numbers_of(held: Column, searched: Column) -> Column:
    """Per held needle the sentences of the row's page that contain it."""
    return T.bound(F.split(searched, APART), lambda parts: F.flatten(F.transform(held, lambda n: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.contains(F.get(parts, i), n)),
        lambda i: F.struct(n.alias("needle"), i.alias("sentence_no"))))))


def sentence_hits(asks: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """F2. Matching sentences in reading order: all, or the first ``limit``.  A page's
    sentences stay in its row until they are found."""
    key = ["page_index", "sentence_no"]
    wanted = needles(asks)
    asked = pages.join(wanted.select("book_id").distinct(), "book_id", "left_semi")
    rows = stage(sentences(asked), "sentences")
    found = contains_pairs(wanted, rows, ["book_id"], ["page_index"], projections, numbers_of)
    hits = found.join(wanted, ["book_id", "needle"]).select("query_id", "book_id", *key)
    first = hits if limit is None else top_rows(hits, ["query_id"], key, limit)
    return first.join(rows, ["book_id", "page_index"]).select(
        "query_id", "book_id", *key, F.get("text", F.col("sentence_no")).alias("sentence")
    )


def display_text(c: Column | str) -> Column:
    return T.strip(F.regexp_replace(T.single_spaced(c), "\\s+", " "))


def first_match(folded: Column, pattern: Column) -> Column:
    """(start, stop) of the first match, the whole text where it has none of its
    own; lengths of pieces, as positions of a match would not be code points."""
    found = F.coalesce(F.length(F.regexp_substr(folded, pattern)), F.lit(0))
    start = F.length(F.split(folded, pattern, 2)[0])
    own = F.struct(start.alias("start"), (start + found).alias("stop"))
    whole = F.struct(F.lit(0).alias("start"), F.length(folded).alias("stop"))
    return F.when(found > 0, own).otherwise(whole)


def widened(shown: Column, hit: Column) -> Column:
    """The part of ``shown`` from the sentence boundary before the hit to the one after."""
    before = F.left(shown, hit["start"])
    opening = F.length(F.regexp_extract(before, f"(?s)^.*[{BOUNDARY}]", 0))
    after = F.substring(shown, hit["stop"] + 1, F.length(shown))
    closing = F.regexp_extract(after, f"(?s)^[^{BOUNDARY}]*[{BOUNDARY}]?", 0)
    return T.strip(F.substring(shown, opening + 1, hit["stop"] + F.length(closing) - opening))


def snippets_of(held: Column, _searched: Column) -> Column:
    """Per held needle its snippet from the row's ``text``, which is brought to
    the display form and folded once."""

    def cut(shown: Column, folded: Column) -> Column:
        return F.transform(held, lambda n: F.struct(n.alias("needle"), T.bound(
            first_match(folded, needle_pattern(n)), lambda hit: widened(shown, hit)
        ).alias("snippet")))

    return T.bound(display_text("text"), lambda shown: T.bound(
        T.fold(shown), lambda folded: cut(shown, folded)))


def snippets(asks: DataFrame, texts: DataFrame, text_id: list[str]) -> DataFrame:
    """F3. (query_id, book_id, text_id, needle, snippet): the first match of the
    phrase widened to sentence boundaries.  ``texts`` has book_id, text_id, text."""
    return matching_rows(asks, texts, text_id, snippets_of)


def fulltext_search(asks: DataFrame, pages: DataFrame, chunks: DataFrame,
                    fallback: int = 30) -> DataFrame:
    """F4. One snippet per matching page; questions without any match get the
    ``fallback`` best chunks instead.  Repeats of a page and text go.

    A direct, case- and accent-insensitive occurrence always is a match of the
    projections too, so one containment join covers direct hits and fallback
    pages; phrases without letters or digits match nothing.
    """
    key = ["page_index"]
    found = snippets(asks, pages, key)
    # Read by the fallback's gate and by the result.
    direct = stage(found.select("query_id", "book_id", "page_index", "snippet"), "direct")
    silent = asks.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    silent = stage(silent.select("query_id", "book_id", F.col("phrase").alias("query")), "silent")
    ranked = Q.retrieve(silent, chunks, fallback).select(
        "query_id", "book_id", "chunk_no"
    )
    guessed = ranked.join(
        chunks.select("book_id", "chunk_no", "page_index", "text"), ["book_id", "chunk_no"]
    ).select("query_id", "book_id", "page_index", T.inline("text").alias("snippet"))
    both = stage(direct.unionByName(guessed), "hits")
    both = both.withColumn("_key", F.lower(T.inline("snippet")))
    return keep_first(both, ["query_id", "page_index", "_key"], ["snippet"]).drop("_key")

"""Exact "text contains needle" joins without forming all pairs.

Every needle is anchored by one short gram that any text holding the needle
must also hold: the eight characters after an inner blank, which texts offer
once per word, or else its first 8, 4, 2 or 1 characters, which texts offer at
every position.  A text meets the needles of its key as maps from gram to
needles in its own row.  Anchors are looked up, needles are checked and what a
caller wants to know of a match is computed there; the searched form is made
once per row, and only (needle, text id, result) leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions.text import bound

SIZES = (8, 4, 2, 1)
PATTERNS = {"w": "(?s) (?=(.{8}))"} | {str(n): "(?s)(?=(.{%d}))" % n for n in SIZES}
NEEDLES_AT_ONCE = 4096
TEXTS_AT_ONCE = 1024
LOOKED_UP = 256


def _anchor(needle: Column) -> tuple[Column, Column]:
    inner = F.regexp_extract(needle, "^[^ ]* (.{8})", 1)
    kind = F.when(inner != "", "w")
    gram = F.when(inner != "", inner)
    for size in SIZES:
        kind = kind.when(F.length(needle) >= size, str(size))
        gram = gram.when(F.length(needle) >= size, F.left(needle, F.lit(size)))
    return kind, gram


def _wanted(needles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, one map of gram -> needles per kind), a row per NEEDLES_AT_ONCE
    needles, so a text never meets an unbounded map."""
    kind, gram = _anchor(F.col("needle"))
    anchored = needles.select(*keys, "needle").where("needle <> ''").distinct().select(
        *keys, "needle", kind.alias("_kind"), gram.alias("_gram")
    )
    blocks = anchored.groupBy(*keys).agg(F.ceil(F.count("*") / NEEDLES_AT_ONCE).alias("_blocks"))
    listed = anchored.join(blocks, keys).groupBy(
        *keys, F.pmod(F.xxhash64("needle"), F.col("_blocks")).alias("_block"), "_kind", "_gram"
    ).agg(F.collect_list("needle").alias("_needles"))
    entry = F.struct("_gram", "_needles")
    return listed.groupBy(*keys, "_block").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("_kind") == k, entry))).alias(f"_w{k}")
        for k in PATTERNS
    ], F.sum(F.size("_needles")).alias("_count")).drop("_block")


def _held(text: Column) -> Column:
    """The needles of the row's maps that ``text`` contains.  Cutting a text into
    grams costs as much as some hundred plain searches: fewer needles than
    LOOKED_UP are searched one by one, with the same result."""
    none = F.expr("cast(array() as array<string>)")

    def of_kind(kind: str) -> Column:
        wanted = F.col(f"_w{kind}")
        offered = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))
        met = F.array_intersect(F.map_keys(wanted), offered)
        checked = F.transform(
            met, lambda g: F.filter(F.element_at(wanted, g), lambda n: F.contains(text, n))
        )
        return F.when(F.size(F.map_keys(wanted)) > 0, F.flatten(checked)).otherwise(none)

    every = F.concat(*[F.flatten(F.map_values(f"_w{k}")) for k in PATTERNS])
    return F.when(
        F.col("_count") < LOOKED_UP, F.filter(every, lambda n: F.contains(text, n))
    ).otherwise(F.concat(*[of_kind(k) for k in PATTERNS]))


def contains_pairs(
    needles: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    text_id: Sequence[str],
    form: Callable[[str], Column] = F.col,
    result: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(keys, needle, text_id) for every text that contains the needle.

    ``needles`` has the keys and ``needle``; ``texts`` has the keys, the
    identifying columns and ``text``.  ``form`` turns the raw text into the one
    that is searched.  ``result`` is computed in the text's row from all held
    needles and the searched form: an array of structs with a field ``needle``,
    whose fields become the columns; by default the needles alone.

    The texts of a key are dealt to blocks of about TEXTS_AT_ONCE, so a key
    that has a third of all texts is many tasks.
    """
    keys, text_id = list(keys), list(text_id)
    sizes = texts.groupBy(*keys).agg(F.ceil(F.count("*") / TEXTS_AT_ONCE).cast("int").alias("_parts"))
    wanted = _wanted(needles, keys).join(sizes, keys).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    )
    # Left joins: the texts stay where they are when the other side is small, and
    # are never the side that is broadcast.
    parts = texts.join(sizes, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*text_id), F.col("_parts")).cast("int")
    )
    rows = parts.drop("_parts").join(wanted.drop("_parts"), [*keys, "_part"], "left")
    tell = result or (lambda held, _: F.transform(held, lambda n: F.struct(n.alias("needle"))))

    def in_row(text: Column) -> Column:
        return bound(_held(text), lambda held: F.when(F.size(held) > 0, tell(held, text)))

    # The outer form: no filter that would search every row twice is derived from it.
    asked = F.when(F.col("_count") > 0, bound(form("text"), in_row))
    found = rows.select(*keys, *text_id, F.explode_outer(asked).alias("_hit")).where("_hit is not null")
    return found.select(*keys, *text_id, "_hit.*")

"""Cutting page text into overlapping chunks (K1, K2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.plans.running import PAGES_PER_BLOCK, block_of, numbered

TARGET = 1200
OVERLAP = 180
SEARCH_BACK = 180


def chunk_source(c: Column | str) -> Column:
    """The text form that chunks are cut from."""
    return T.strip(F.regexp_replace(T.single_spaced(c), "\\n{3,}", "\n\n"))


def windows(c: Column | str, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Array of chunk texts of one segment.

    Each cut depends on the previous one, so a fold carries the rest of the
    text: look for the last sentence mark in the final stretch of the window,
    cut there, and step back by the overlap.  The fold has as many steps as
    the shortest possible advance allows, and idles once the text is used up.
    """
    x = T.col(c)
    back = min(SEARCH_BACK, target)
    advance = max(1, target - back + 1 - overlap)
    steps = F.when(F.length(x) <= target, 1).otherwise(
        F.ceil((F.length(x) - target) / advance) + 1
    ).cast("int")

    def cut(state: Column, _step: Column) -> Column:
        rest, size, out = state["rest"], state["size"], state["out"]
        tail = F.substring(rest, target - back + 1, back)
        marked = F.length(F.regexp_extract(tail, "(?s)^.*[.!?。！？\\n]", 0))
        length = F.when(size <= target, size).otherwise(
            T.bound(marked, lambda m: F.when(m > 0, m + (target - back)).otherwise(target))
        )

        def advance_by(end: Column) -> Column:
            skip = F.greatest(F.lit(1), end - F.least(F.lit(overlap), end))
            left = F.when(size <= end, F.lit(0)).otherwise(size - skip)
            return F.struct(
                F.substring(rest, skip + 1, left).alias("rest"),
                left.alias("size"),
                F.array_append(out, T.strip(F.substring(rest, F.lit(1), end))).alias("out"),
            )

        return F.when(size == 0, state).otherwise(T.bound(length, advance_by))

    start = F.struct(
        x.alias("rest"),
        F.length(x).alias("size"),
        F.expr("cast(array() as array<string>)").alias("out"),
    )
    pieces = F.aggregate(F.sequence(F.lit(1), steps), start, cut, lambda s: s["out"])
    return F.filter(pieces, lambda piece: piece != "")


def cut_segments(segments: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """K1 on segments: one row per chunk, without a running number."""
    pieces = segments.select(
        "book_id",
        "page_index",
        "seg_no",
        F.posexplode(windows("text", target, overlap)).alias("piece_no", "text"),
        "path",
    )
    return pieces.select(
        "book_id",
        "page_index",
        "seg_no",
        "piece_no",
        F.element_at(F.when(F.size("path") > 0, F.col("path")), -1).alias("chapter_title"),
        F.col("path").alias("chapter_path"),
        "text",
    )


def number_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_no`` from 0: the place of a chunk in its book."""
    numbered_rows = numbered(
        chunks,
        ["book_id"],
        ["page_index", "seg_no", "piece_no"],
        block_of("page_index", PAGES_PER_BLOCK),
        "_n",
    )
    return numbered_rows.withColumn("chunk_no", F.col("_n") - 1).drop("_n")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """K2."""
    return chunks.groupBy("book_id").agg(
        F.count("*").alias("n_chunks"),
        F.sum(T.estimated_tokens("text")).alias("n_tokens"),
        F.sum(F.length("text")).alias("n_chars"),
    )

"""Pipelines over whole books: index once, then answer batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.operators import chunks as K
from pagework.operators import outline as O
from pagework.operators import pack as P
from pagework.operators import retrieve as Q
from pagework.plans.stage import spread, stage


def build_chunks(pages: DataFrame, outline: DataFrame | None) -> DataFrame:
    """Page text -> chunks with chapter paths, as a staged table.

    The table is written once because every later step (numbering, token
    statistics, expansion, packing) reads a different part of it.
    """
    source = pages.select("book_id", "page_index", K.chunk_source("text").alias("text"))
    if outline is None:
        none = F.expr("cast(array() as array<string>)")
        segments = source.withColumn("seg_no", F.lit(0)).withColumn("path", none)
    else:
        segments = O.page_segments(source, O.outline_paths(outline))
    return stage(K.cut_segments(segments), "chunks")


def build_index(pages: DataFrame, outline: DataFrame | None) -> DataFrame:
    """Staged chunks with their running number.  Numbers are computed on the
    narrow key columns and joined back to the text."""
    chunks = build_chunks(pages, outline)
    key = ["book_id", "page_index", "seg_no", "piece_no"]
    return chunks.join(K.number_chunks(chunks.select(*key)), key)


def build_stored_index(pages: DataFrame, outline: DataFrame | None) -> DataFrame:
    """The index as a stored table, read with all cores."""
    return spread(stage(build_index(pages, outline), "index"), "book_id", "chunk_no")


def reading_context(pages: DataFrame, outline: DataFrame, asks: DataFrame) -> DataFrame:
    """Question -> packed excerpts, for all questions at once.

    Retrieval works on keys and token counts; chunk text is fetched only for
    the at most 14 chunks a question keeps.
    """
    chunks = build_stored_index(pages, outline)
    chosen = Q.retrieve_for_reading(asks, chunks)
    budget = Q.reading_budgets(asks).select("query_id", "token_budget")
    rows = chosen.drop("page_index").join(chunks, ["book_id", "chunk_no"]).join(budget, "query_id")
    return P.pack_context(rows)

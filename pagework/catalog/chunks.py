"""Queries over chunking (K1, K2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import outline as _outline  # noqa: F401  (defines the chunk tables)
from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.operators import chunks as K
from pagework.plans import reading as R
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def k1_make_chunks(spark, sf):
    chunks = R.build_index(D.pages(spark, sf), D.outline(spark, sf))
    return chunks.select(
        "book_id",
        "chunk_no",
        "page_index",
        "chapter_title",
        F.array_join("chapter_path", " › ").alias("path"),
        F.md5("text").alias("digest"),
    )


def k2_chunk_stats(spark, sf):
    return K.chunk_stats(R.build_chunks(D.pages(spark, sf), D.outline(spark, sf)))


ORACLE["k1_make_chunks"] = with_tables(
    "SELECT book_id, chunk_no, page_index, title AS chapter_title, "
    "array_to_string(path, ' › ') AS path, md5(text) AS digest FROM chunks"
)
ORACLE["k2_chunk_stats"] = with_tables(
    f"SELECT book_id, count(*) AS n_chunks, CAST(sum({sql.token_estimate('text')}) AS BIGINT) "
    "AS n_tokens, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY ALL"
)

QUERIES["k1_make_chunks"] = k1_make_chunks
QUERIES["k2_chunk_stats"] = k2_chunk_stats

"""Cleaning pipeline over ``documents``: each stage takes what the one before kept.

Toxic documents go; repeated blocks are cut out of later documents; of near
copies one document stays; documents with benchmark passages go; the rest is
encoded, and decoded again as a check.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.llm import bpe, decontaminate, linededup, simhash, toxicity
from pagework.llm.common import id_hash, table
from pagework.plans.stage import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.  Labels of the ids that are
    held out elsewhere are not learned from."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_hash() % 4 != 2)
    scored = toxicity.score(docs, model)
    return scored.where("predicted = 0").select(*docs.columns)


def cut_repeated_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; blocks that an earlier one has are cut out of the later."""
    done = linededup.dedup(docs)
    changed = F.col("removed_words") > 0
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (shingles of five words, similarity 0.8 or
    more) the document with the smallest id."""
    return simhash.keep_similar_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_and_decode(docs, path, tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_blocks),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Models, alignments and merges are not expressible in SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None

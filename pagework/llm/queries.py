"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

import public_tokenizers as tokenizers

from pyspark.sql import functions as F

from pagework.llm import bpe, counts, decontaminate, jaccard, licenses, linededup, lm, phrases, pii, resample, search, simhash, toxicity
from pagework.llm.common import id_hash, table

QUERIES = {}
ORACLE = {}


def op1_bpe_round_trip(spark, sf):
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf, "documents"), path, tokenizers.PATTERN)


def op2_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"), id_hash() % 4 != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_hash() % 4 == 2).alias("held_out"), F.col("score"), "predicted")


def op3_decontamination(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = counts.count_tokens(docs, tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_pii(spark, sf):
    return pii.digest(table(spark, sf, "documents"))


def op6_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hexadecimal("simhash").alias("fingerprint"), "component_id")


def op7_language_model(spark, sf):
    scored = lm.scored(table(spark, sf, "documents"), id_hash() % 7 != 2)
    return scored.withColumn("held_out", id_hash() % 7 == 2)


def op8_top_k(spark, sf):
    return search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op8_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

def op9_line_dedup(spark, sf):
    done = linededup.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "removed_words", F.length(text).cast("bigint").alias("n_chars"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))


def op10_license_scan(spark, sf):
    return licenses.report(table(spark, sf, "documents"), licenses.notices(spark))


def op11_resampling(spark, sf):
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_jaccard_join(spark, sf):
    return jaccard.alike_documents(table(spark, sf, "documents"))


def op13_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


QUERIES["op1_bpe_round_trip"] = op1_bpe_round_trip
QUERIES["op2_toxicity"] = op2_toxicity
QUERIES["op3_decontamination"] = op3_decontamination
QUERIES["op4_token_counts"] = op4_token_counts
QUERIES["op5_pii"] = op5_pii
QUERIES["op6_simhash"] = op6_simhash
QUERIES["op7_language_model"] = op7_language_model
QUERIES["op8_top_k"] = op8_top_k
QUERIES["op9_line_dedup"] = op9_line_dedup
QUERIES["op10_license_scan"] = op10_license_scan
QUERIES["op11_resampling"] = op11_resampling
QUERIES["op12_jaccard_join"] = op12_jaccard_join
QUERIES["op13_collocations"] = op13_collocations

"""Exact top-k inner products by MaxScore (operator 8).

Vectors are cut into shards of bounded size and queries into blocks; every
(shard, block) pair is one group.  Inside a shard each dimension is a term whose
postings are the vectors' distances from the dimension's worst end: for a
positive query component the value above the shard's minimum, for a negative one
that below its maximum, so all contributions are at least zero and start from
one common base.  A term's score bound is its largest contribution.

A few likely vectors are scored first and give a floor.  By descending bound,
terms are essential until the bounds of the rest together cannot lift a vector
above the floor.  The postings of essential terms are traversed; the others are
only probed for vectors that are still competitive.  Shards send their k best,
which are merged by score and vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 1024
SEED_TERMS, SEEDS, EVERY = 8, 8, 4
SAFE = 1 << 24  # components below this are multiplied in 64-bit integers


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not null itself."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~broken


class Shard:
    """The postings of one shard, by dimension."""

    def __init__(self, ids: np.ndarray, vectors: list, width: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        matrix = _matrix([vectors[i] for i in order], width)
        self.low, self.high = matrix.min(axis=0), matrix.max(axis=0)
        self.columns = np.ascontiguousarray(matrix.T)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors other than the query's own."""
        worst = np.where(query > 0, self.low, self.high)
        base = (query * worst).sum()
        bound = np.abs(query) * (self.high - self.low)
        terms = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # bound of a term and all after it
        others = np.flatnonzero(self.ids != own)

        def contribution(term: int, of: np.ndarray) -> np.ndarray:
            return query[term] * (self.columns[term][of] - worst[term])

        floor = base  # a score that k vectors are known to reach
        if len(others) > k:
            sample = sum(contribution(t, others) for t in terms[:SEED_TERMS])
            likely = others[np.argpartition(-sample, min(SEEDS * k, len(others) - 1))[: SEEDS * k]]
            floor = np.sort(base + sum(contribution(t, likely) for t in terms))[-k:][0]
        split = int(np.argmax(base + left <= floor)) if (base + left <= floor).any() else len(terms)
        essential, optional = terms[:split], terms[split:]

        alive, score = others, np.full(len(others), base, self.columns.dtype)
        for step, term in enumerate(essential):
            score = score + contribution(term, alive)
            if step % EVERY == EVERY - 1:
                alive, score, floor = _competitive(alive, score, left[step + 1], floor, k)
        for step, term in enumerate(optional, split):
            alive, score, floor = _competitive(alive, score, left[step], floor, k)
            score = score + contribution(term, alive)
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


def _competitive(alive, score, rest, floor, k):
    """Vectors that the remaining bound can still lift to the floor (ties may win
    by id).  Contributions are never negative, so partial scores raise the floor."""
    if len(alive) > k:
        floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
    keep = score + rest >= floor
    return (alive, score, floor) if keep.all() else (alive[keep], score[keep], floor)


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows as integers, filled with zeros; Python integers where 64 bits might not do."""
    small = all(len(r) == 0 or np.abs(r).max() < SAFE for r in rows)
    out = np.zeros((len(rows), width), np.int64 if small else object)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row if small else [int(x) for x in row]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the ``k`` vectors of
    other ids with the highest integer inner products, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows with a
    null id, take no part.  Shorter vectors count as filled up with zeros.  Rows
    that repeat an id are candidates each by itself; a query id with several
    rows is searched once, with its least vector.  Scores beyond 64 bits are an
    error.  An empty table, or one without queries, gives no rows.
    """
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(vec_id).cast("bigint").alias("id"), quantised(F.col(vector)).alias("v"), is_query.alias("q"))
    sizes = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = -(-sizes[0] // shard) or 1, -(-sizes[1] // block) or 1
    # Repeated ids must not fill one shard: rows are dealt by id and content.
    here = rows.select(
        F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v", F.lit(False).alias("asks"),
    )
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    there = asked.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v", F.lit(True).alias("asks"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        held, asking = group[~group["asks"]], group[group["asks"]].sort_values("id")
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(held) and len(asking):
            width = max(map(len, group["v"]))
            part = Shard(held["id"].to_numpy(), list(held["v"]), width)
            questions = _matrix(list(asking["v"]), width)
            for own, question in zip(asking["id"], questions, strict=True):
                if part.columns.dtype == object:
                    question = question.astype(object)
                ids, scores = part.search(own, question, k)
                found["query_id"] += [own] * len(ids)
                found["vec_id"] += ids.tolist()
                found["score"] += [int(s) for s in scores]
        return pd.DataFrame(found)

    grouped = here.unionByName(there).groupBy("shard", "block")
    best = grouped.applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

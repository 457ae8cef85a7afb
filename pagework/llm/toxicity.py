"""Counterfactual-regularised toxicity classifier (operator 2).

A logistic model over words and word beginnings is trained in numpy on a
bounded sample of labelled documents.  Labelled texts that name a group get
counterfactuals in which the term is swapped for others of its kind; the loss
penalises the squared change of the score, so that a term which merely occurs
more often in toxic texts cannot carry weight by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import Bounded, once, small_batches, with_result

SAMPLE = 12_000  # labelled documents that are fitted, at most
BUCKETS = 1 << 20
FEATURES = 6_000  # hashed features with a weight, at most
THRESHOLD = 0.3
WORDS_KEPT = 200_000

# Groups of terms that may be swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf"),
)

WORD = re.compile(r"[^\W_]+")


def _index(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def word_features(word: str) -> tuple[int, ...]:
    """The word, and its first four and five letters."""
    out = [_index("w" + word)]
    out += [_index(f"{n}{word[:n]}") for n in (4, 5) if len(word) > n]
    return tuple(out)


def text_features(words: set[str], memo) -> np.ndarray:
    found = set()
    for word in words:
        found.update(memo[word])
    return np.fromiter(found, np.int32, len(found))


def counterfactuals(words: set[str], groups: Sequence[Sequence[str]], swaps: int | None = None) -> list[set[str]]:
    """The text's words with the terms of one group swapped for each of its other
    terms, for every group in the text: at most as many as the groups have terms,
    or the first ``swaps``."""
    out = []
    for group in groups:
        present = words & set(group)
        if present:
            rest = words - present
            out += [rest | {other} for other in sorted(set(group) - present)]
    return out[:swaps]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def logit(self, features: np.ndarray) -> float:
        return self.bias + sum(self.weights.get(int(f), 0.0) for f in features)


class _Rows:
    """Sparse rows of ones: products with a vector and its transpose."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def transposed(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, x[self.row], self.width)


def fit(texts: list[np.ndarray], labels: Sequence[int], swapped: list[tuple[int, np.ndarray]], penalty: float = 1.0, ridge: float = 2e-4, steps: int = 400, rate: float = 0.05) -> Model:
    """Minimise log loss + ``penalty`` * mean squared score change between a text
    and its counterfactuals + ``ridge`` * |w|^2, by Adam on all rows.

    Features are those whose share differs most (by z) between the labels; the
    terms that counterfactuals swap always keep theirs.  Without rows or with one
    label only the model is the labels' share.
    """
    y = np.asarray(labels, float)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model({}, bias)
    columns = np.concatenate(texts) if texts else np.empty(0, np.int64)
    marks = np.repeat(y, [len(t) for t in texts])
    total = np.bincount(columns, minlength=BUCKETS)
    toxic = np.bincount(columns, marks, minlength=BUCKETS)
    rate_of = total / len(y)
    z = np.abs(toxic - total * share) / np.sqrt(total * share * (1 - share) * (1 - np.minimum(rate_of, 0.999)) + 1e-9)
    z[total < 3] = 0
    forced = {int(f) for at, other in swapped for f in np.setxor1d(texts[at], other)}
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = np.unique(np.array([*chosen[z[chosen] > 4], *forced], np.int64))
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def inside(row: np.ndarray) -> np.ndarray:
        p = place[row]
        return p[p >= 0]

    rows = _Rows([inside(t) for t in texts], len(chosen))
    origin = np.array([at for at, _ in swapped], np.int64)
    others = _Rows([inside(t) for _, t in swapped], len(chosen))
    w, m, v = np.zeros((3, len(chosen) + 1))
    w[-1] = bias
    for step in range(1, steps + 1):
        logits = rows.dot(w[:-1]) + w[-1]
        error = (1 / (1 + np.exp(-logits)) - y) / len(y)
        gradient = np.append(rows.transposed(error) + 2 * ridge * w[:-1], error.sum())
        if len(origin):
            change = (rows.dot(w[:-1])[origin] - others.dot(w[:-1])) * (2 * penalty / len(origin))
            gradient[:-1] += rows.transposed(np.bincount(origin, change, rows.n)) - others.transposed(change)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({int(c): float(x) for c, x in zip(chosen, w, strict=False) if abs(x) > 1e-3}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, identity=IDENTITY, sample: int = SAMPLE, penalty: float = 1.0) -> Model:
    """Fit on at most ``sample`` labelled documents, those whose ids hash lowest
    among the rows of ``labels`` for which ``usable`` (over doc_id) holds.

    Labels that are null are no labels; of several labels of one id the highest
    holds; of several documents with one id the first text in order is read.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` rows of two numbers are broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    kind = "struct<own: array<int>, swapped: array<array<int>>>"

    @F.arrow_udf(kind)
    def featurise(column: pa.Array) -> pa.Array:
        memo = once("toxicity", "words", "plain", lambda: Bounded(word_features, WORDS_KEPT))
        own, swapped = [], []
        for text in column:
            words = set(WORD.findall((text.as_py() or "").lower()))
            own.append(text_features(words, memo))
            swapped.append([text_features(w, memo) for w in counterfactuals(words, identity)])
        kinds = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([pa.array(own, kinds[0]), pa.array(swapped, kinds[1])], ["own", "swapped"])

    got = texts.select("doc_id", "toxic", featurise("text").alias("f")).toArrow().sort_by("doc_id")
    struct = got["f"].combine_chunks()
    rows = [np.asarray(r.values) for r in struct.field("own")]
    pairs = [(i, np.asarray(x, np.int32)) for i, r in enumerate(struct.field("swapped").to_pylist()) for x in r]
    return fit(rows, got["toxic"].to_pylist(), pairs, penalty=penalty)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).  Null
    and empty texts get the score of no words.  Rows are independent; columns
    that have one of the names are replaced.  The model holds at most FEATURES
    weights (besides those of swapped terms) and travels with the tasks.
    """
    small_batches(docs.sparkSession)
    weights, bias = model.weights, model.bias
    version = hash((bias, tuple(weights.items())))

    @F.arrow_udf("struct<score: double>")
    def run(texts: pa.Array) -> pa.Array:
        make = lambda: Bounded(lambda word: tuple(f for f in word_features(word) if f in weights), WORDS_KEPT)
        memo = once("toxicity", "weighted", version, make)
        out = []
        for value in texts:
            found = set()
            for features in map(memo.__getitem__, set(WORD.findall((value.as_py() or "").lower()))):
                if features:
                    found.update(features)
            out.append(bias + sum(weights[f] for f in sorted(found)))
        scores = 1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500)))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64())], ["score"])

    scored = with_result(docs, run(F.col(text)), ["score"])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

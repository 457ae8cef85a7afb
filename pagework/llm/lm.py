"""Log-bilinear language model with noise-contrastive estimation (operator 7).

Symbols are the most frequent words, the end, and classes of the other words by
their last two letters.  A symbol's score is bilinear: (A1[previous] +
A2[before that]) . T[symbol] + bias[symbol].  Every task trains on all training
texts of its partition in numpy, with shared noise samples and matrix products;
the tasks' parameters are averaged by tokens over the whole corpus (iterative
parameter mixing), with reduction on the executors.  Scores are normalised: for
the distinct contexts of a batch one matrix product gives the logits of all
symbols, whose log-sum is remembered.  A word outside the symbols is its class
times its add-one share in the class, from the counts of the whole corpus.

Counts of the most frequent words travel with the tasks (HEAD bounds them); the
counts of all other words are joined by word.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import alone, once, small_batches
from pagework.plans.stage import stage

SYMBOLS = 1024  # words that are symbols of their own
CLASSES = 256
HEAD = 150_000  # words whose counts travel with the tasks
SIZE = 16  # of a representation
NOISE = 64
BATCH = 2048
RATE = 0.15
ROUNDS = 1
END = b"\n"  # cannot be a word
FLUSH = 300_000  # distinct words a task counts before it sends them on


def tokens_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Tokens of all texts one after the other (words between ASCII blanks with A-Z
    in lower case, then the end), and each text's number of them."""
    words, sizes = [], []
    for value in texts:
        text = value.as_py()
        own = text.encode().lower().split() if text else []
        words += own
        words.append(END)
        sizes.append(len(own) + 1)
    return words, np.array(sizes, np.int64)


def _class(word: bytes) -> int:
    return zlib.crc32(word.decode()[-2:].encode()) % CLASSES


class _Known(dict):
    """Places of known words; others are at -1 and are not remembered."""

    def __missing__(self, word: bytes) -> int:
        return -1


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; the end of every text counts as END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(counts: Counter) -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        alone("lm")
        counts: Counter = Counter()
        for batch in batches:
            counts.update(tokens_of(batch.column(0))[0])
            if len(counts) > FLUSH:
                yield sent(counts)
                counts = Counter()
        yield sent(counts)

    parts = docs.select(text).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Parameters and the statistics that normalise words outside the symbols."""

    def __init__(self, head: dict[bytes, int], symbols: list[bytes], class_totals: np.ndarray, tokens: int, types: int):
        self.tokens, self.types = tokens, types
        self.first_class = len(symbols)
        self.start = self.first_class + CLASSES
        self.count = self.start + 1
        self.class_cost = np.log10(class_totals + 1.0)
        own = {word: i for i, word in enumerate(symbols)}
        self.place = _Known(zip(head, range(len(head)), strict=True))
        # One more entry, for place -1.
        self.symbol_at = np.array([own.get(w, self.first_class + _class(w)) for w in head] + [0], np.int64)
        self.log_at = np.log10(np.array([*head.values(), 0], float) + 1)
        counts = np.ones(self.count)
        counts[: self.first_class] += [head.get(w, 0) for w in symbols]
        counts[self.first_class : self.start] += class_totals
        counts[self.start] = 0
        self.noise = counts / counts.sum()
        generator = np.random.default_rng(7)
        self.a1, self.a2, self.t = (generator.normal(0, 0.1, (self.count, SIZE)).astype(np.float32) for _ in range(3))
        self.bias = np.log(np.maximum(self.noise, 1e-12)).astype(np.float32)
        self.bias[self.start] = -1e9  # never predicted

    def parameters(self) -> np.ndarray:
        """Rows a1, a2, t of every symbol and its bias, one row per symbol."""
        return np.concatenate([self.a1, self.a2, self.t, self.bias[:, None]], axis=1)

    def load(self, table: np.ndarray) -> None:
        self.a1, self.a2, self.t = (np.ascontiguousarray(table[:, i * SIZE : (i + 1) * SIZE], np.float32) for i in range(3))
        self.bias = table[:, 3 * SIZE].astype(np.float32)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of every token, and its place among the known words or -1."""
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        numbers = self.symbol_at[place]
        unknown = np.flatnonzero(place < 0)
        numbers[unknown] = [self.first_class + _class(words[i]) for i in unknown]
        return numbers, place

    def trained(self, batches: Iterator[tuple[list[bytes], np.ndarray]]) -> int:
        """One pass of NCE with Adagrad over tokens and sizes; returns their number."""
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in (self.a1, self.a2, self.t, self.bias)]
        self.cdf = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * np.maximum(self.noise, 1e-12)).astype(np.float32)
        generator = np.random.default_rng(11)
        rest, seen = np.empty((3, 0), np.int64), 0
        for words, sizes in batches:
            rest = np.concatenate([rest, contexts(self.symbols(words)[0], sizes, self.start)], axis=1)
            full = rest.shape[1] // BATCH * BATCH
            seen += self._steps(rest[:, :full], generator)
            rest = rest[:, full:]
        return seen + self._steps(rest, generator)

    def _steps(self, triples: np.ndarray, generator) -> int:
        for at in range(0, triples.shape[1], BATCH):
            self._step(*triples[:, at : at + BATCH], generator)
        return triples.shape[1]

    def _step(self, before: np.ndarray, previous: np.ndarray, target: np.ndarray, generator) -> None:
        noise = np.minimum(np.searchsorted(self.cdf, generator.random(NOISE)), self.start - 1)
        query = self.a1[previous] + self.a2[before]
        real = self.t[target]
        delta = (query * real).sum(axis=1) + self.bias[target] - self.log_noise[target]
        g = _sigmoid(-delta)  # of the data
        other = query @ self.t[noise].T + self.bias[noise] - self.log_noise[noise]
        h = -_sigmoid(other)  # of the noise
        to_query = g[:, None] * real + h @ self.t[noise]
        to_t = _scatter(target, g[:, None] * query, self.count)
        np.add.at(to_t, noise, h.T @ query)
        to_bias = np.bincount(target, g, self.count)
        np.add.at(to_bias, noise, h.sum(axis=0))
        steps = (_scatter(previous, to_query, self.count), _scatter(before, to_query, self.count), to_t, to_bias)
        tables = (self.a1, self.a2, self.t, self.bias)
        for table, square, step in zip(tables, self.squares, steps, strict=True):
            step = (step / len(target)).astype(np.float32)
            square += step * step
            table += RATE * step / np.sqrt(square)
        self.bias[self.start] = -1e9

    def ready(self) -> Model:
        self.pair1, self.pair2 = self.a1 @ self.t.T, self.a2 @ self.t.T
        self.log_sums = np.full((self.count, self.count), np.nan, np.float32)
        return self

    def log_probabilities(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log-probability of every symbol after its context in its text."""
        before, previous, target = contexts(symbols, sizes, self.start)
        sums = self.log_sums[before, previous]
        if np.isnan(sums).any():
            new = np.unique(before[np.isnan(sums)].astype(np.int64) * self.count + previous[np.isnan(sums)])
            for at in range(0, len(new), 512):
                b, p = np.divmod(new[at : at + 512], self.count)
                logits = (self.a1[p] + self.a2[b]) @ self.t.T + self.bias
                top = logits.max(axis=1)
                self.log_sums[b, p] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
            sums = self.log_sums[before, previous]
        return self.pair1[previous, target] + self.pair2[before, target] + self.bias[target] - sums


def contexts(symbols: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """Rows: symbol two before, symbol before (``start`` before a text), symbol."""
    first = np.cumsum(sizes) - sizes
    out = np.empty((3, len(symbols)), np.int64)
    out[2], out[1, 1:], out[0, 2:] = symbols, symbols[:-1], symbols[:-2]
    out[1, first] = out[0, first] = start
    out[0, first[sizes > 1] + 1] = start
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    where = rows[:, None] * SIZE + np.arange(SIZE)
    return np.bincount(where.ravel(), values.ravel(), count * SIZE).reshape(count, SIZE)


def _mixed(docs: DataFrame, model: Model, text: str) -> np.ndarray:
    """Parameters after one pass over all rows, averaged by tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    width = 3 * SIZE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Model = pickle.loads(shared.value)
        seen = mine.trained(tokens_of(batch.column(0)) for batch in batches)
        if seen:
            table = mine.parameters().astype(np.float64) * seen
            arrays = [pa.array(np.arange(mine.count)), pa.array(np.full(mine.count, seen)), *[pa.array(table[:, i]) for i in range(width)]]
            yield pa.RecordBatch.from_arrays(arrays, ["symbol", "seen", *[f"p{i}" for i in range(width)]])

    kind = "symbol bigint, seen bigint, " + ", ".join(f"p{i} double" for i in range(width))
    parts = docs.select(text).mapInArrow(run, kind)
    # One row per symbol comes back; each task has sent as many.
    mixed = parts.groupBy("symbol").agg(*[(F.sum(f"p{i}") / F.sum("seen")).alias(f"p{i}") for i in range(width)])
    got = mixed.toPandas().sort_values("symbol")
    return np.round(got.drop(columns="symbol").to_numpy(), 6) if len(got) else model.parameters()


def train(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows, and the (word, n) counts in the shared folder."""
    small_batches(docs.sparkSession)
    counts = stage(word_counts(docs, text), "lm-counts")
    end = END.decode()
    at_end = F.sum(F.when(F.col("word") == end, F.col("n")))
    totals = counts.agg(F.sum("n"), F.count("*"), at_end).first()
    head = {r.word.encode(): r.n for r in counts.orderBy(F.desc("n"), "word").limit(HEAD).toLocalIterator()}
    words = [w for w in head if w != END]
    head |= {END: totals[2]} if totals[2] else {}
    symbols = [END, *words[:SYMBOLS]]
    suffix = F.pmod(F.crc32(F.encode(F.right("word", F.lit(2)), "UTF-8")), F.lit(CLASSES))
    inside = counts.where(F.col("word") != end).groupBy(suffix.alias("class")).agg((F.sum("n") + F.count("*")).alias("n"))
    class_totals = np.zeros(CLASSES)
    for row in inside.collect():  # at most CLASSES rows
        class_totals[row["class"]] = row["n"]
    for word in symbols[1:]:
        class_totals[_class(word)] -= head[word] + 1
    model = Model(head, symbols, class_totals, totals[0] or 0, totals[1])
    for _ in range(ROUNDS):
        model.load(_mixed(docs, model, text))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row.

    A null or empty text is its end alone.  Rows that repeat an id and a text
    get the same result each; ids may be null.  Without training rows all counts
    are zero.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    model_key, token = (model.tokens, model.types), id(shared)
    kind = "struct<n_tokens: bigint, n_known: bigint, base: double, score: double, rest: array<string>>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        mine: Model = once("lm", "model", (model_key, token), lambda: pickle.loads(shared.value).ready())
        words, sizes = tokens_of(texts)
        symbols, place = mine.symbols(words)
        logs = mine.log_at[place]
        outside = symbols >= mine.first_class
        gain = mine.log_probabilities(symbols, sizes) / np.log(10)
        gain[outside] += logs[outside] - mine.class_cost[symbols[outside] - mine.first_class]
        first = np.cumsum(sizes) - sizes
        known, base, score = (np.add.reduceat(x, first) for x in ((place >= 0).astype(np.int64), logs, gain))
        rest = pa.array([words[i] for i in np.flatnonzero(place < 0)], pa.binary()).cast(pa.string())
        offsets = np.concatenate([[0], np.cumsum(sizes - known)]).astype(np.int32)
        arrays = [pa.array(sizes), pa.array(known), pa.array(base), pa.array(score.astype(np.float64)), pa.ListArray.from_arrays(pa.array(offsets), rest)]
        return pa.StructArray.from_arrays(arrays, ["n_tokens", "n_known", "base", "score", "rest"])

    key = F.xxhash64(text).alias("key")
    parts = stage(docs.select("doc_id", key, run(F.col(text)).alias("r")).select("doc_id", "key", "r.*"), "lm-parts")
    tail = parts.select("doc_id", "key", F.explode("rest").alias("word"))
    looked = tail.join(counts.where(F.col("word") != END.decode()), "word")
    found = looked.select("doc_id", "key", F.log10(F.col("n") + 1.0).alias("logs"), F.lit(1).cast("bigint").alias("times"), F.lit(0).alias("copies"))
    marks = parts.select("doc_id", "key", F.lit(0.0).alias("logs"), F.lit(0).cast("bigint").alias("times"), F.lit(1).alias("copies"))
    sums = found.unionByName(marks).groupBy("doc_id", "key").agg(
        (F.sum("logs") / F.sum("copies")).alias("more"), (F.sum("times") / F.sum("copies")).cast("bigint").alias("more_known")
    )
    same = parts["doc_id"].eqNullSafe(sums["doc_id"]) & (parts["key"] == sums["key"])
    joined = parts.drop("rest").join(sums, same).drop(sums["doc_id"]).drop(sums["key"])
    whole = float(np.log10(model.tokens + model.types + 1))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )


def scored(docs: DataFrame, training: Column) -> DataFrame:
    """Train on the rows for which ``training`` holds and score all."""
    rows = docs.select("doc_id", "text")
    model, counts = train(rows.where(training))
    return score(rows, model, counts)

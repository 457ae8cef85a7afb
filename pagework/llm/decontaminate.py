"""Benchmark decontamination by Wu-Manber search over words (operator 3).

The symbols are words.  For every pattern length a shift table says for each
block of two words how far the window may move on; blocks that no pattern holds
skip the whole length.  Where the shift is zero, the hash of the last two words
picks a bucket, the hash of the first two a part of it, and direct comparison
confirms the occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import alone, small_batches, with_result

WINDOW = 10
BLOCK = 2
ITEM_BYTES = 2 << 20  # item text that one pass over the documents searches for
FIELDS = ["n_words", "hits", "items"]
KIND = "struct<n_words: bigint, hits: array<struct<first: int, last: int>>, items: array<string>>"

# Fixed value: a word, in UTF-8 after A-Z have been lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []  # bytes.lower: A-Z only


class WuManber:
    """Patterns of one length (in words)."""

    def __init__(self, length: int, patterns: dict[tuple, set]):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            bucket = self.buckets.setdefault(words[length - self.block :], {})
            bucket.setdefault(words[: self.block], []).append((words, items))

    def search(self, words: tuple) -> Iterator[tuple[int, set]]:
        """(first word, items) of every occurrence."""
        length, block, far, shift = self.length, self.block, self.far, self.shift.get
        end, n = length, len(words)
        while end <= n:
            move = shift(words[end - block : end], far)
            if move:
                end += move
                continue
            first = end - length
            bucket = self.buckets[words[end - block : end]]
            for pattern, items in bucket.get(words[first : first + block], ()):
                if words[first:end] == pattern:
                    yield first, items
            end += 1


class Searcher:
    """All windows of the items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        by_length: dict[int, dict[tuple, set]] = {}
        self.number: dict[bytes, int] = {}
        for item, text in items:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(words[at : at + size], set()).add(item)
        self.machines = [WuManber(n, by_length[n]) for n in sorted(by_length)]

    def run(self, text: str | None) -> tuple[int, list, list]:
        found = words_of(text)
        number = self.number.get
        words = tuple([number(w, 0) for w in found])
        spans, items = [], set()
        for machine in self.machines:
            for first, owners in machine.search(words):
                items |= owners
                spans.append((first, first + machine.length - 1))
        return len(found), union(spans), sorted(items)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (both ends included) with touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _struct(rows: list[tuple[int, list, list]]) -> pa.Array:
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])
    return pa.array([{"n_words": n, "hits": [{"first": a, "last": b} for a, b in hits], "items": items} for n, hits, items in rows], kind)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ITEM_BYTES (or one item), so that neither
    the driver nor a worker ever holds more than one block's text."""
    block, size = [], 0
    chosen = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    for item, words in chosen.select(F.col(item_id).cast("string"), text).toLocalIterator():
        if block and size + len(words.encode()) > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words.encode())
    yield block


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Append ``n_words``, ``hits`` (word spans inside occurrences, both ends
    included, disjoint) and ``items`` (ids, as sorted strings, of items that have
    an occurring window).

    Null and empty texts have no words and no hits.  Items whose id or text is
    null, or which have no words, take no part; repeated items count once.  Every
    document row is judged by itself.  Columns named like a result are replaced.
    Items are searched for in blocks of bounded size; each is broadcast and its
    findings are joined with those of the blocks before in the same row.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def searched(block: list) -> Column:
        shared = spark.sparkContext.broadcast(block)
        made: dict = {}

        @F.arrow_udf(KIND)
        def run(texts: pa.Array) -> pa.Array:
            alone("decontaminate")
            if "searcher" not in made:
                made["searcher"] = Searcher(shared.value, window)
            return _struct([made["searcher"].run(t.as_py()) for t in texts])

        return run(F.col(text))

    @F.arrow_udf(KIND)
    def joined(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            spans = [(s["first"], s["last"]) for s in a["hits"] + b["hits"]]
            rows.append((a["n_words"], union(spans), sorted({*a["items"], *b["items"]})))
        return _struct(rows)

    out = None
    for block in _blocks(items, item_id, item_text):
        found = searched(block)
        out = found if out is None else joined(out, found)
    return with_result(docs, out, FIELDS)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document with the digest columns of the query."""
    found = find_windows(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )

"""Token counts with a whole-token shortcut (operator 4).

Before any text is read it is proved for every vocabulary string whether it
encodes alone as one token: the pre-tokenizer must leave it whole and the merges
must lead to it.  Pre-tokens that are such a string count one each; only the
rest is merged, and its count is remembered per pre-token.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.bpe import pattern_of
from pagework.llm.common import Bounded, once, small_batches, with_result

PIECES_KEPT = 600_000
# Fixed value: how the byte-level pre-tokenizer splits.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Counts the tokens of whole texts for one tokenizer file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        strips = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if not plain or strips or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError("only plain byte-level BPE files are counted")
        letters = byte_letters()
        self.letter = [letters[b] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {tuple(pair): rank for rank, pair in enumerate(pairs)}
        self.find = pattern_of(BYTE_LEVEL).findall
        specials = [t["content"] for t in spec["added_tokens"]]
        alternatives = "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))
        self.special = regex.compile(alternatives) if specials else None
        self.pieces = Bounded(self.merged, PIECES_KEPT)
        self.whole = frozenset(self._prove(model["vocab"], letters))
        self.ones = dict.fromkeys(self.whole, 1)

    def _prove(self, vocabulary, letters):
        back = {letter: byte for byte, letter in letters.items()}
        for token in vocabulary:
            try:
                text = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # not a text by itself
            if self.find(text) == [text] and self.merged(text) == 1:
                yield text

    def merged(self, piece: str) -> int:
        """Number of tokens the merges leave of one pre-token."""
        parts = [self.letter[b] for b in piece.encode()]
        n, ends = len(parts), list(range(1, len(parts) + 1))
        before, heap = list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (rank := self.merges.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (rank, i, j, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        left = n
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if parts[i] != a or ends[i] != j or parts[j] != b:
                continue
            parts[i], parts[j], ends[i] = a + b, None, ends[j]
            if ends[j] < n:
                before[ends[j]] = i
            left -= 1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return left

    def count(self, text: str) -> int:
        total = 0
        spans = [text]
        if self.special is not None and self.special.search(text):
            spans = self.special.split(text)
            total = len(spans) - 1
        ones, pieces = self.ones, self.pieces
        for span in spans:
            found = self.find(span)
            rest = [p for p in found if p not in ones]
            total += len(found) - len(rest) + sum(map(pieces.__getitem__, rest))
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).  A
    null or empty text has no bytes and no tokens.  Rows are independent; columns
    that already have one of the names are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, "rb") as file:
        blob = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("struct<n_tokens: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        counter = once("counts", "counter", path, lambda: Counter(blob.value))
        out = [counter.count(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array(out, pa.int64())], ["n_tokens"])

    counted = with_result(docs, run(F.col(text)), ["n_tokens"])
    size = F.coalesce(F.octet_length(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("bigint")
    return counted.withColumn("n_bytes", size).withColumn("over_limit", F.col("n_tokens") > limit)

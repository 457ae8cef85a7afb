"""Byte-level BPE by a lazily determinised finite-state transducer (operator 1).

The merges are compiled into a nondeterministic transducer: a hypothesis is the
row of tokens chosen so far and a place in the trie of all tokens.  A token may
follow another only if merging the two tokens' bytes gives just these two
(`follows`); a row whose neighbours all pass this test is the one the merges
produce, so after every byte exactly one hypothesis stands at the trie's root.

Determinisation is lazy: a state is the set of live hypotheses, each written as
its last token and its place in the trie; a transition gives the last token of
all bytes read so far, which also tells where the token before it ends.  Tokens
are emitted once all live hypotheses have them in common; hypotheses live no
longer than the longest token, so the lookahead is bounded.  States and
transitions are made when first needed and forgotten at a limit.

Decoding runs token by token through an incremental UTF-8 machine whose state
is the unfinished character.  Bytes that cannot be part of a character become
U+FFFD, and so does an unfinished character at the end.
"""

from __future__ import annotations

import base64
import heapq
import math
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import Bounded, Recent, once, small_batches, with_result

PIECES_KEPT = 130_000  # in each half of the memo
STATES_KEPT = 160_000
LONG = 1 << 16  # longer texts are cut into pieces one by one
ROOT = 0
# Hypotheses and moves are kept as one number each, to save memory: a
# token + 1 (0: none) above a node, a state * 256 above a token + 1.
# A state is the bytes of its hypotheses' numbers.
SHIFT = 24
LOW = (1 << SHIFT) - 1


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from the text of a rank file."""
    pairs = (line.split() for line in blob.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge(piece: bytes, ranks: dict[bytes, int], below: float = math.inf) -> list[bytes]:
    """The merges' own result for ``piece``: lowest rank first, leftmost on ties,
    ranks from ``below`` on left out.  A heap over a linked list, so that long
    pieces cost n log n."""
    n = len(piece)
    ends = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))
    heap = []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n:
            rank = ranks.get(piece[start : ends[middle]])
            if rank is not None and rank < below:
                heapq.heappush(heap, (rank, start, middle, ends[middle]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, start, middle, end = heapq.heappop(heap)
        if not (alive[start] and ends[start] == middle and alive[middle] and ends[middle] == end):
            continue
        ends[start], alive[middle] = end, False
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, i = [], 0
    while i < n:
        out.append(piece[i : ends[i]])
        i = ends[i]
    return out


class Transducer:
    """Bytes in, token ids out; ``start`` is the first state."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at, self.depth = array("i", [-1]), array("i", [0])
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.lookahead = 4 * max(self.length.values(), default=1)
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            self.token_at[node] = rank
        self.ends = bytearray(b"\x01") * len(self.token_at)  # 1: no token goes on from the node
        for key in self.child:
            self.ends[key >> 8] = 0
        self.split = Bounded(self._split, len(ranks) + 1)  # every token
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.moves: dict[int, int] = {}  # state * 256 + byte -> state * 256, token + 1
        self.start = self._number(array("Q", [ROOT]).tobytes()) << 8 + SHIFT

    def _number(self, state: bytes) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _split(self, token: int) -> tuple[int, ...]:
        """The two tokens that the last merge of ``token`` joins; a byte has none.
        More parts: merges of lower rank do not make the token."""
        parts = merge(self.bytes_of[token], self.ranks, token)
        return tuple(self.ranks[p] for p in parts) if len(parts) > 1 else ()

    def _follows(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes end with these two (of the
        right one's alone: with it, if ``left`` is negative).

        The merges of both sides are undone, the latest first.  One across the
        border that comes before the merge undone last forbids the pair: of equal
        ranks the leftmost comes first.  Where ranks do not tell the order of
        merges, the bytes are merged.
        """
        ends = [self.bytes_of[t] for t in (left, right) if t >= 0]
        limit = math.inf
        while True:
            lefts, rights = self.split[left] if left >= 0 else (), self.split[right]
            if len(lefts) > 2 or len(rights) > 2:
                return merge(b"".join(ends), self.ranks) == ends
            if left < 0:
                return True
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < limit:
                return False
            if lefts and (left > right or not rights):
                limit, left = left, lefts[1]
            elif rights:
                limit, right = right + 1, rights[0]
            else:
                return True

    def move(self, key: int) -> int:
        """Next state, and the last token of all bytes so far plus one."""
        state, byte = self.states[key >> 8], key & 255
        living, ended = [], -1
        child, token_at, ends, follows = self.child, self.token_at, self.ends, self._follows
        for hypothesis in array("Q", state):
            node = child.get((hypothesis & LOW) << 8 | byte)
            if node is None:
                continue
            last = hypothesis >> SHIFT
            if not ends[node]:
                living.append(last << SHIFT | node)
            token = token_at[node]
            if token >= 0 and ended < 0 and follows(last - 1, token):
                ended = token
        living.append(ended + 1 << SHIFT | ROOT)
        self.moves[key] = known = self._number(array("Q", living).tobytes()) << 8 + SHIFT | ended + 1
        return known

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one piece, each as soon as all hypotheses share it."""
        if len(self.states) > STATES_KEPT:
            self.forget()
        known, moves = self.start, self.moves
        lasts: list[int] = []  # state and last token after each byte not yet emitted
        for byte in data:
            key = known >> SHIFT | byte
            known = moves.get(key)
            known = self.move(key) if known is None else known
            lasts.append(known)
            if len(lasts) >= self.lookahead:
                yield from self._certain(lasts)
        yield from self._back(lasts, len(lasts))

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The row of tokens that ends at ``end``."""
        out = []
        while end:
            out.append((lasts[end - 1] & LOW) - 1)
            end -= self.length[out[-1]]
        return out[::-1]

    def _certain(self, lasts: list[int]) -> list[int]:
        """Tokens before the place where all live rows meet; they leave ``lasts``."""
        state = lasts[-1] >> 8 + SHIFT
        places = {len(lasts) - self.depth[h & LOW] for h in array("Q", self.states[state])}
        while len(places) > 1:
            latest = max(places)
            places.remove(latest)
            places.add(latest - self.length[(lasts[latest - 1] & LOW) - 1])
        meet = places.pop()
        out = self._back(lasts, meet)
        del lasts[:meet]
        return out

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) >= self.lookahead:
            return list(self.stream(piece))
        if len(self.states) > STATES_KEPT:
            self.forget()
        known, lasts = self.start, []
        get, move = self.moves.get, self.move
        for byte in piece:
            known = get(known >> SHIFT | byte) or move(known >> SHIFT | byte)
            lasts.append(known)
        return self._back(lasts, len(lasts))


# Fixed values of UTF-8: lead bytes -> (bytes that follow, range of the first one).
LEADS = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
LEADS |= {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)} | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F)}
LEADS |= {b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)} | {0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


def utf8_step(pending: bytes, byte: int) -> tuple[str, bytes]:
    """One byte: (finished text, unfinished character)."""
    broken = ""
    if pending:
        follow, low, high = LEADS[pending[0]]
        if len(pending) > 1:
            low, high = 0x80, 0xBF
        if low <= byte <= high:
            pending += bytes([byte])
            return (pending.decode(), b"") if len(pending) == follow + 1 else ("", pending)
        broken = "�"
    if byte < 0x80:
        return broken + chr(byte), b""
    if byte in LEADS:
        return broken, bytes([byte])
    return broken + "�", b""


class Decoder:
    """Token ids -> text, with a memo of (unfinished character, token) steps."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.steps = Bounded(self._step, 100_000)
        self.whole: dict[int, str] = {}
        for rank, token in self.bytes_of.items():
            text, pending = self._step((b"", rank))
            if not pending:
                self.whole[rank] = text

    def _step(self, key: tuple[bytes, int]) -> tuple[str, bytes]:
        pending, token = key
        out = []
        for byte in self.bytes_of[token]:
            text, pending = utf8_step(pending, byte)
            out.append(text)
        return "".join(out), pending

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        pending = b""
        for token in ids:
            text, pending = self.steps[pending, token]
            yield text
        if pending:
            yield "�"

    def decode(self, ids: Sequence[int]) -> str:
        try:  # every token holds whole characters
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            return "".join(self.stream(ids))


def pattern_of(pattern: str):
    # White space as the Unicode property, which is what the tokenizer's engine means.
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _ranks(ranks_path: str, blob) -> dict[bytes, int]:
    """One table per worker, for encoding and decoding."""
    return once("bpe", "ranks", ranks_path, lambda: read_ranks(blob.value))


def _encoded(texts: pa.Array, ranks_path: str, pattern: str, blob) -> list[bytes]:
    def make():
        machine = Transducer(_ranks(ranks_path, blob))
        return Recent(lambda piece: array("I", machine.encode(piece.encode())).tobytes(), PIECES_KEPT)

    pieces = once("bpe", "encode", (ranks_path, pattern), make)
    found = once("bpe", "pattern", pattern, lambda: pattern_of(pattern))

    def pieces_of(text: str) -> Iterable[str]:
        return found.findall(text) if len(text) < LONG else (m[0] for m in found.finditer(text))

    return [b"".join(map(pieces.__getitem__, pieces_of(t.as_py() or ""))) for t in texts]


def _decoded(rows: list[bytes | None], ranks_path: str, blob) -> list[str]:
    decoder = once("bpe", "decode", ranks_path, lambda: Decoder(_ranks(ranks_path, blob)))
    return [decoder.decode(np.frombuffer(r or b"", "<u4").astype("u4").data) for r in rows]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Append ``ids`` (binary: little-endian unsigned 32-bit token ids) and
    ``n_tokens``.  A null or empty text has no tokens.  Rows are independent:
    repeated rows give repeated results, an empty table gives an empty one, and
    columns already called ``ids`` or ``n_tokens`` are replaced.  The vocabulary,
    whose size the rank file fixes, is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as file:
        blob = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("struct<ids: binary, n_tokens: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        out = _encoded(texts, ranks_path, pattern, blob)
        counts = pa.array([len(x) // 4 for x in out], pa.int64())
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), counts], ["ids", "n_tokens"])

    return with_result(docs, run(F.col(text)), ["ids", "n_tokens"])


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded``: the text of the token ids (null: empty).  An id that
    the vocabulary lacks is an error."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as file:
        blob = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("struct<decoded: string>")
    def run(rows: pa.Array) -> pa.Array:
        out = _decoded([r.as_py() for r in rows], ranks_path, blob)
        return pa.StructArray.from_arrays([pa.array(out, pa.string())], ["decoded"])

    return with_result(docs, run(F.col(ids)), ["decoded"])


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in the same Python process: appends ``ids``,
    ``n_tokens`` and ``decoded``."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as file:
        blob = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("struct<ids: binary, n_tokens: bigint, decoded: string>")
    def run(texts: pa.Array) -> pa.Array:
        out = _encoded(texts, ranks_path, pattern, blob)
        counts = pa.array([len(x) // 4 for x in out], pa.int64())
        arrays = [pa.array(out, pa.binary()), counts, pa.array(_decoded(out, ranks_path, blob), pa.string())]
        return pa.StructArray.from_arrays(arrays, ["ids", "n_tokens", "decoded"])

    return with_result(docs, run(F.col(text)), ["ids", "n_tokens", "decoded"])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both: the columns of the query."""
    coded = encode_and_decode(docs.select("doc_id", "text"), ranks_path, pattern)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )

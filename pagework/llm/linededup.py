"""Line deduplication by pairwise alignment (operator 9).

A line is what a line break or the end of a sentence ends; a word whose hash is
divisible by 12 ends one too, so that endless lines are cut where their content
says.  Documents meet through anchors: hashes of runs of ANCHOR words, wherever
lines end, of which the least of every WINNOW in a row is kept.  A passage of
LEAST words holds a full window, so wherever it stands it keeps the same anchor.
The earliest document with an anchor is paired with every later one (a star,
never all pairs of a group).  That document may have the anchor and nothing else
of the passage, so runs of LEAST words are winnowed and paired in the same way:
what two documents share of 50 words or more also meets a holder of a whole block.

A pair is aligned by patience diff over its line hashes: common ends first, then
the longest increasing row of lines that are unique on both sides, then the
longest common run where no line is unique.  Aligned blocks are extended word by
word into the lines around them; those of ``least`` words or more are deleted from
the later document; the alignment is repeated without them, so that passages in
another order are found too.  Where it finds no more, common runs of ``least`` words
are widened and taken, the longest row of them first, until there is none.  Hashes
only propose: every block is compared word by word.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import alone, small_batches
from pagework.plans.stage import stage

ANCHOR = 10
LEAST = 30
WINNOW = LEAST - ANCHOR + 1
CUT = 12
BYTES_AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
SPANS = "array<struct<first: int, last: int>>"


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as needed."""

    def __init__(self):
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1024)
            steps = np.full((2, self.n), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def run_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[first:end] for every pair, independent of its place.  The
    length is part of it: a value of zero at the end of a run would leave no trace."""
    up, down = POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    sizes = (np.asarray(end) - first).astype(np.uint64)
    return _mix((sums[end] - sums[first]) * down[first] ^ _mix(sizes * np.uint64(BASE)))


Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def words_of(texts: list[bytes]) -> tuple[Units, np.ndarray]:
    """Words of several texts at once: their hashes, the text each belongs to, the
    number of words of that text up to each, and where each text's words start;
    and the words that end a line."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    place = np.cumsum([0, *[len(t) + 1 for t in texts]])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    rows = np.searchsorted(start, place)
    owner = np.repeat(np.arange(len(texts)), np.diff(rows))
    words = run_hashes(data, start, end)
    closes = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) | (words % CUT == 0)
    if len(start):
        breaks = np.cumsum(data == 10)[start]
        closes[:-1] |= breaks[1:] != breaks[:-1]
        closes[-1] = True
    return (words, owner, np.arange(1, len(start) + 1) - rows[owner], rows), np.flatnonzero(closes)


def _lines(units: Units, closing: np.ndarray) -> Units:
    words, owner, ends, rows = units
    first = np.concatenate([[0], closing[:-1] + 1])[: len(closing)]
    return run_hashes(words, first, closing + 1), owner[closing], ends[closing], np.searchsorted(closing, rows)


def lines_of(texts: list[bytes]) -> Units:
    """Lines of several texts at once: their hashes, the text each belongs to, the
    word of that text each ends before, and where each text's lines start."""
    return _lines(*words_of(texts))


def _least_of(values: np.ndarray, window: int) -> np.ndarray:
    """The least of every ``window`` values in a row."""
    size = 1
    while size < window:
        step = min(size, window - size)
        values = np.minimum(values[:-step], values[step:])
        size += step
    return values


def anchors_of(units: np.ndarray, owner: np.ndarray, ends: np.ndarray, rows: np.ndarray, length: int = ANCHOR, window: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, anchor), by text, of units that are words or lines.  Texts of fewer
    than ``length`` words have none; of texts with few runs all are kept."""
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    starts[rows[:-1][rows[:-1] < len(units)]] = 0
    # One increasing scale for all texts, so that one search finds every run's end.
    scale = np.cumsum(ends - starts)
    last = np.searchsorted(scale, scale - (ends - starts) + length)
    whole = np.flatnonzero(last < rows[owner + 1])
    runs, text = run_hashes(units, whole, last[whole] + 1), owner[whole]
    few = np.bincount(text, minlength=len(rows))[text] < window
    least, of = runs[few], text[few]
    if len(runs) >= window:
        inside = text[: len(runs) - window + 1] == text[window - 1 :]
        least = np.concatenate([least, _least_of(runs, window)[inside]])
        of = np.concatenate([of, text[: len(inside)][inside]])
    order = np.argsort(of, kind="stable")
    least, of = least[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
    return of[new], least[new]


def meeting_keys(units: Units, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(text, key), by text: anchors, and runs of ``least`` words."""
    length = min(ANCHOR, least)
    window = least - length + 1
    found = [anchors_of(*units, length, window)]
    if window > 1:
        found.append(anchors_of(*units, least, window))
    of, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return of[order], keys[order]


def _longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run, by halving."""
    low, high, best = 1, min(len(a), len(b)), (0, 0, 0)
    while low <= high:
        size = (low + high) // 2
        first_a, first_b = np.arange(len(a) - size + 1), np.arange(len(b) - size + 1)
        _, i, j = np.intersect1d(run_hashes(a, first_a, first_a + size), run_hashes(b, first_b, first_b + size), return_indices=True)
        if len(i):
            k = int(i.argmin())
            best, low = (int(i[k]), int(j[k]), size), size + 1
        else:
            high = size - 1
    return best


def _unique_row(a: list, b: list) -> tuple[list[tuple[int, int]], bool]:
    """Longest row, increasing on both sides, of lines unique on both sides; and
    whether the sides share a line at all."""
    count_a, count_b = Counter(a), Counter(b)
    shared = count_a.keys() & count_b.keys()
    single = {x for x in shared if count_a[x] == 1 == count_b[x]}
    where = {x: j for j, x in enumerate(b) if x in single}
    pairs = [(i, where[x]) for i, x in enumerate(a) if x in single]
    tails, ends, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        back[n] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [j], [n]
    row, n = [], ends[-1] if ends else -1
    while n >= 0:
        row.append(pairs[n])
        n = back[n]
    return row[::-1], bool(shared)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned (line of a, line of b), increasing on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        row, shared = _unique_row(a[i:m], b[j:n])
        if shared and not row:
            x, y, size = _longest_run(np.array(a[i:m], np.uint64), np.array(b[j:n], np.uint64))
            row = [(x + k, y + k) for k in range(size)]
        at_i, at_j = i, j
        for x, y in row:
            out.append((i + x, j + y))
            todo.append((at_i, i + x, at_j, j + y))
            at_i, at_j = i + x + 1, j + y + 1
        if row:
            todo.append((at_i, m, at_j, n))
    return sorted(out)


@dataclass
class Side:
    """A text as word hashes, with the words before each line and the end, the
    hashes of its lines and of its runs of ``least`` words."""

    words: np.ndarray
    before: np.ndarray
    lines: np.ndarray
    runs: np.ndarray


def sides_of(texts: list[bytes], least: int = LEAST) -> list[Side]:
    out = []
    for part in _parts(texts):
        (words, owner, ends, rows), closing = words_of(part)
        at = np.searchsorted(closing, rows)
        lines = _lines((words, owner, ends, rows), closing)[0]
        runs = run_hashes(words, first := np.arange(max(len(words) - least + 1, 0)), first + least)
        for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)):
            before = np.concatenate([[0], ends[closing[at[i] : at[i + 1]]]])
            out.append(Side(words[a:b], before, lines[at[i] : at[i + 1]], runs[a : max(b - least + 1, a)]))
    return out


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many values the two have in common before they first differ."""
    n = min(len(a), len(b))
    other = a[:n] != b[:n]
    return int(other.argmax()) if other.any() else n


class _Open:
    """The words of the later text that no block has taken yet, and the starts of
    the runs of ``least`` open words that the earlier text has too."""

    def __init__(self, later: Side, earlier: Side, least: int):
        self.later, self.earlier, self.least = later, earlier, least
        self.taken = np.zeros(len(later.words) + 2, bool)  # one closed word at each end
        self.taken[[0, -1]] = True
        self.hit = np.isin(later.runs, earlier.runs)
        self.found: list[tuple[int, int]] = []

    def take(self, first: int, end: int) -> None:
        self.taken[first + 1 : end + 1] = True
        self.hit[max(0, first - self.least + 1) : end] = False
        self.found.append((first, end))

    def widened(self, first: int, end: int, at: int) -> tuple[int, int]:
        """The span, which the earlier text has at ``at``, with the open common
        words around it.  A span that the earlier text does not have there, or one
        with a taken word, is empty."""
        a, b = self.later.words, self.earlier.words
        after = at + end - first
        if self.taken[first + 1 : end + 1].any() or not np.array_equal(a[first:end], b[at:after]):
            return first, first
        ahead = int(self.taken[end + 1 :].argmax())
        behind = int(self.taken[first::-1].argmax())
        end += _same(a[end : end + ahead], b[after : after + ahead])
        return first - _same(a[first - behind : first][::-1], b[max(at - behind, 0) : at][::-1]), end

    def aligned(self) -> list[tuple[int, int]]:
        """Spans of ``least`` words or more by one patience alignment of the lines
        that reach into a hit."""
        reach = np.zeros(len(self.later.words) + 1, np.int64)
        starts = np.flatnonzero(self.hit)
        np.add.at(reach, starts, 1)
        np.add.at(reach, starts + self.least, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(reach[:-1]) > 0)])
        before, other = self.later.before, self.earlier.before
        mine = np.flatnonzero(inside[before[1:]] > inside[before[:-1]])
        theirs = np.flatnonzero(np.isin(self.earlier.lines, self.later.lines[mine]))
        blocks: list[list[int]] = []
        for i, j in patience(self.later.lines[mine].tolist(), self.earlier.lines[theirs].tolist()):
            x, y = int(mine[i]), int(theirs[j])
            if blocks and blocks[-1][1] == x and blocks[-1][2] == y:
                blocks[-1][1:] = [x + 1, y + 1]
            else:
                blocks.append([x, x + 1, y + 1])
        # Nothing is taken before all blocks of the alignment are known.
        wide: list[tuple[int, int]] = []
        for x, y, j in blocks:
            first, end = int(before[x]), int(before[y])
            if wide and end <= wide[-1][1] or not self.hit[max(0, first - self.least + 1) : end].any():
                continue
            span = self.widened(first, end, int(other[j - (y - x)]))
            if span[1] - span[0] >= self.least:
                wide.append(span)
        return wide

    def longest(self) -> tuple[int, int]:
        """The widest span around the longest row of hits, or an empty one."""
        starts = np.flatnonzero(self.hit)
        rows = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
        first = int(max(rows, key=len)[0])
        places = np.flatnonzero(self.earlier.runs == self.later.runs[first])
        return max((self.widened(first, first + self.least, int(p)) for p in places), key=lambda s: s[1] - s[0])


def common_blocks(later: Side, earlier: Side, least: int = LEAST) -> list[tuple[int, int]]:
    """Word spans (end exclusive) of the later text that the earlier one has too;
    what is left has no run of ``least`` words in common with it."""
    state = _Open(later, earlier, least)
    if not state.hit.any():
        return []
    # Common ends first: a whole copy ends here.
    head = _same(later.words, earlier.words)
    if head >= least:
        state.take(0, head)
    n = len(later.words) - head if head >= least else len(later.words)
    tail = min(_same(later.words[::-1], earlier.words[::-1]), n)
    if tail >= least:
        state.take(len(later.words) - tail, len(later.words))
    aligning = True
    while state.hit.any():
        new = state.aligned() if aligning else []
        aligning = bool(new)
        if not new:
            first, end = state.longest()
            if end == first:  # equal hashes of runs that differ
                state.hit[int(state.hit.argmax())] = False
                continue
            new = [(first, end)]
        for span in new:
            state.take(*span)
    return state.found


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the blanks after them."""
    places = [m.span() for m in re.finditer(r"[^\x20\t-\r]+", text)]
    keep, at = [], 0
    for first, end in _united(spans):
        keep.append(text[at : places[first][0]])
        at = places[end][0] if end < len(places) else len(text)
    rest = "".join(keep) + text[at:]
    return rest.rstrip() if at == len(text) else rest


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of about BYTES_AT_ONCE."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= BYTES_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.array([[{"first": a, "last": b} for a, b in row] for row in rows], kind)


def repeated_blocks(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, blocks): word spans (end exclusive) of blocks that an
    earlier document, one of smaller doc_id, has as well."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<bigint>")
    def cut(texts: pa.Array) -> pa.Array:
        alone("linededup")
        sizes, keys = [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
        for part in _parts([t.as_py() or b"" for t in texts.cast(pa.binary())]):
            of, own = meeting_keys(words_of(part)[0], least)
            keys.append(own.view(np.int64))
            sizes.append(np.bincount(of, minlength=len(part)))
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))

    @F.arrow_udf(SPANS)
    def align(later: pa.Array, earlier: pa.Array) -> pa.Array:
        alone("linededup")
        own, others = ([t.as_py() or b"" for t in x.cast(pa.binary())] for x in (later, earlier))
        distinct = list(dict.fromkeys(others))
        held = dict(zip(distinct, sides_of(distinct, least), strict=True))
        return _spans([common_blocks(a, held[b], least) for a, b in zip(sides_of(own, least), others, strict=True)])

    # The joins below are merge joins at every size: nothing is broadcast.
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(text).alias("text"))
    # Keys are dealt out once, for their owners and for the pairs.
    keys = named.select("doc_id", F.explode(cut("text")).alias("key")).repartition("key")
    owners = keys.groupBy("key").agg(F.min("doc_id").alias("owner_id"), F.max("doc_id").alias("latest"))
    owners = owners.where("latest > owner_id").drop("latest")
    pairs = keys.join(owners.hint("merge"), "key").where("doc_id > owner_id").select("doc_id", "owner_id").distinct()
    pairs = stage(pairs, "line-pairs")
    # Texts of unpaired documents are moved once only, and then left behind.
    paired = pairs.select(F.explode(F.array("doc_id", "owner_id")).alias("doc_id")).distinct()
    held = stage(named.join(paired.hint("merge"), "doc_id", "left_semi"), "paired-texts")
    later = held.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    earlier = held.select(F.col("doc_id").alias("owner_id"), F.col("text").alias("earlier"))
    both = pairs.join(later.hint("merge"), "doc_id").join(earlier.hint("merge"), "owner_id")
    aligned = both.select("doc_id", "text_hash", align("text", "earlier").alias("blocks")).where(F.size("blocks") > 0)
    return aligned.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("blocks")).alias("blocks"))


def dedup(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with the blocks cut out of ``text``, and ``removed_words``.

    Documents are ordered by doc_id; the earliest keeps its text.  Words are what
    stands between ASCII blanks.  Rows that share a doc_id never delete from each other, and rows with a null doc_id are left
    alone.  Null texts stay null; a text that is a block as a whole becomes empty.
    All findings refer to the texts as they came in, so the order of work does not
    matter.  A column ``removed_words`` is replaced; an empty table stays empty.
    Words are compared by 64-bit hashes.
    """
    blocks = repeated_blocks(docs.select("doc_id", text), least, text)

    @F.arrow_udf("struct<text: string, removed: bigint>")
    def apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, removed = [], []
        for value, found in zip(texts, spans.to_pylist(), strict=True):
            own = value.as_py()
            rows = [(s["first"], s["last"]) for s in found or []]
            out.append(cut_out(own, rows) if rows else own)
            removed.append(sum(b - a for a, b in _united(rows)))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed, pa.int64())], ["text", "removed"])

    names = [c for c in docs.columns if c != "removed_words"]
    marked = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("__hash", F.xxhash64(text))
    found = blocks.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of"), F.col("blocks").alias("__blocks"))
    joined = marked.join(found.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__of")), "left")
    # Only texts that change go to Python.
    changed = F.col("__blocks").isNotNull()
    done = joined.withColumn("__r", apply(F.when(changed, F.col(text)), F.col("__blocks")))
    new = F.when(changed, F.col("__r.text")).otherwise(F.col(text)).alias(text)
    kept = [new if c == text else F.col(f"`{c}`") for c in names]
    return done.select(*kept, F.col("__r.removed").alias("removed_words"))

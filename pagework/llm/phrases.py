"""Phrase collocation mining with counting quotient filters (operator 13).

Words are counted first.  Those that occur ``least`` times in their language get
an id, the most frequent the smallest; every other word only separates, since a
phrase is no more frequent than its words.  Texts become rows of ids, and phrases
are counted length by length: ids are packed to a key, every task collects its
keys in a counting quotient filter (``quotient``), and the filters' sorted blocks
are merged across tasks.  A phrase of k words is only counted where both of its
parts of k - 1 words may be frequent: a bit set of fixed size says so, which errs
to one side only, so counts are exact at every size.

What grows with the corpus stays in tables.  Tasks get the HEAD most frequent
words (a bounded number) and the bit set; ids of rarer words are joined.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.llm import quotient
from pagework.llm.common import alone, numbered, small_batches
from pagework.plans.stage import stage

LONGEST = 5
LEAST = 100
REPORT = 2000
KEEP = 100  # percent of its count that a longer phrase must have to absorb one
SCALE = 1000
HEAD = 1 << 18  # words whose ids travel with the tasks
SIEVE_BITS = 26  # the bit set of frequent parts has 2 ** SIEVE_BITS bits
ENTRIES_AT_ONCE = 1 << 21
WORDS_PER_BLOCK = 1 << 18
WORDS_HELD = 1 << 20
SALTS = 64
UNDETERMINED = "und"

# Fixed value: what ends a piece of text besides line ends.
ENDS = b".,;:!?\n\x0b\x0c\r"
STOP = b"."
TABLE = bytes(STOP[0] if b in ENDS else b for b in bytes(range(256)).lower())


def tokens_of(text: str | None) -> list[bytes]:
    """Words, and STOP wherever a piece ends."""
    return text.encode().translate(TABLE).replace(STOP, b" . ").split() if text else []


def language(column: str = "lang") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(UNDETERMINED))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("phrases")
        seen: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                counts.pop(STOP, None)
                words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counts.values(), pa.int64())], ["lang", "word", "f"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[lang].update(tokens_of(text.as_py()))
            if sum(map(len, seen.values())) > WORDS_HELD:
                yield from rows()
        yield from rows()

    return texts.mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def encode(texts: DataFrame, words: DataFrame, known: int, head: int) -> DataFrame:
    """(lang, ids) of (lang, text): little-endian 32-bit ids, zero for a separator.

    ``words`` (lang, word, id) has ``known`` rows.  The first ``head`` of them go to
    the tasks.  If there are more, words that the tasks do not know leave the row
    with their places, meet their ids in a join, and are put back.
    """
    spark = texts.sparkSession
    rows = words.where(F.col("id") <= head).select("lang", "word", "id").toArrow()
    book: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word, number in zip(*(rows[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
        book[lang][word.encode()] = number
    held = spark.sparkContext.broadcast(dict(book))
    beyond = known > head
    kind = "lang string, ids binary" + (", row bigint, rare array<struct<place: int, word: string>>" if beyond else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("phrases")
        for batch in batches:
            langs, out, rare = batch.column(0).to_pylist(), [], []
            for lang, text in zip(langs, batch.column(1), strict=True):
                tokens = tokens_of(text.as_py())
                get = held.value.get(lang, {}).get
                ids = np.fromiter(map(get, tokens, repeat(0)), "<u4", len(tokens))
                out.append(ids.tobytes())
                if beyond:
                    rare.append([{"place": int(i), "word": tokens[i].decode()} for i in np.flatnonzero(ids == 0) if tokens[i] != STOP])
            arrays = [pa.array(langs, pa.string()), pa.array(out, pa.binary())]
            if beyond:
                arrays += [batch.column(2), pa.array(rare, pa.list_(pa.struct([("place", pa.int32()), ("word", pa.string())])))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "ids", "row", "rare"][: len(arrays)])

    if not beyond:
        return stage(texts.mapInArrow(run, kind), "phrase-ids")
    coded = stage(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, kind), "phrase-heads")
    asked = coded.select("row", "lang", F.explode("rare").alias("r")).select("row", "lang", "r.*")
    found = asked.join(words.where(F.col("id") > head).hint("merge"), ["lang", "word"])
    found = found.groupBy("row").agg(F.collect_list(F.struct("place", "id")).alias("late"))

    @F.arrow_udf("binary")
    def put_back(ids: pa.Array, late: pa.Array) -> pa.Array:
        out = []
        for data, rows in zip(ids, late.to_pylist(), strict=True):
            own = np.frombuffer(data.as_py(), "<u4").copy()
            for r in rows or []:
                own[r["place"]] = r["id"]
            out.append(own.tobytes())
        return pa.array(out, pa.binary())

    whole = coded.join(found.hint("merge"), "row", "left")
    return stage(whole.select("lang", put_back("ids", "late").alias("ids")), "phrase-ids")


def pack(ids: list[np.ndarray], bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in a row as a key of two numbers of ``half`` bits."""
    high, low = (np.zeros(len(ids[0]), np.uint64) for _ in range(2))
    for place, part in enumerate(ids):
        part, at = part.astype(np.uint64), bits * place
        if at < half:
            low |= part << np.uint64(at)
            if at + bits > half:
                high |= part >> np.uint64(half - at)
        else:
            high |= part << np.uint64(at - half)
    return high, low & np.uint64((1 << half) - 1)


def unpack(high: np.ndarray, low: np.ndarray, size: int, bits: int, half: int) -> np.ndarray:
    """One row of ``size`` ids per key."""
    out, mask = [], np.uint64((1 << bits) - 1)
    for place in range(size):
        at = bits * place
        if at >= half:
            part = high >> np.uint64(at - half)
        else:
            part = low >> np.uint64(at)
            if at + bits > half:
                part = part | high << np.uint64(half - at)
        out.append(part & mask)
    return np.stack(out, axis=1).astype(np.int32) if out else np.empty((len(high), 0), np.int32)


def _half(size: int, bits: int) -> int:
    return -(-size * bits // 2)


def _sieve_place(high: np.ndarray, low: np.ndarray, lang: str, sieve_bits: int) -> np.ndarray:
    """The bit of a permuted key of a language."""
    salt = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little"))
    x = (high ^ salt) * np.uint64(0x9E3779B97F4A7C15) + low * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - sieve_bits)).astype(np.int64)


def _keys(parts: list[np.ndarray], size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return quotient.permute(*pack(parts, bits, _half(size, bits)), _half(size, bits))


def _windows(ids: np.ndarray, lang: str, size: int, bits: int, sieve: np.ndarray | None, sieve_bits: int) -> list[np.ndarray]:
    """Columns of ids of all phrases of ``size`` words whose parts may be frequent."""
    n = len(ids) - size + 1
    if n <= 0:
        return [ids[:0]] * size
    known = ids != 0
    if sieve is None:
        good = np.ones(n + 1, bool)
        for k in range(size - 1):
            good &= known[k : n + 1 + k]
    else:  # parts of size - 1 words, one more than there are phrases
        part = np.flatnonzero(np.logical_and.reduce([known[k : n + 1 + k] for k in range(size - 1)]))
        at = _sieve_place(*_keys([ids[part + k] for k in range(size - 1)], size - 1, bits), lang, sieve_bits)
        good = np.zeros(n + 1, bool)
        good[part] = sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1
    start = np.flatnonzero(good[:-1] & good[1:] & known[size - 1 :])
    return [ids[start + k] for k in range(size)]


def count_phrases(coded: DataFrame, size: int, bits: int, lead: int, least: int, sieve: np.ndarray | None, sieve_bits: int) -> DataFrame:
    """(lang, ids, f) of the phrases of ``size`` words that occur ``least`` times."""
    spark = coded.sparkSession
    half = _half(size, bits)
    lead = min(lead, half)
    held = spark.sparkContext.broadcast(sieve)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("phrases")
        filters: dict[str, list] = defaultdict(list)  # per language: sorted keys and counts
        waiting: dict[str, list] = defaultdict(list)

        def settle(lang: str) -> None:
            ids = np.concatenate(waiting.pop(lang))
            columns = _windows(ids, lang, size, bits, held.value, sieve_bits)
            if len(columns[0]):
                filters[lang].append(quotient.count_sorted(*_keys(columns, size, bits), None, half))

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            parts = filters.pop(lang, [])
            if parts:
                found = quotient.blocks(*quotient.merged(parts, half), half, lead)
                for at in range(0, len(found), 64):
                    some = found[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([b for b, _ in some], pa.int64()), pa.array([d for _, d in some], pa.binary())],
                        ["lang", "block", "entries"],
                    )

        gap = np.zeros(1, "<u4")
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                waiting[lang] += [np.frombuffer(data.as_py(), "<u4"), gap]
            for lang in [x for x, parts in waiting.items() if sum(map(len, parts)) >= ENTRIES_AT_ONCE // 4]:
                settle(lang)
                if sum(len(p[0]) for p in filters[lang]) >= ENTRIES_AT_ONCE:
                    yield from rows(lang)
        for lang in list(waiting):
            settle(lang)
        for lang in list(filters):
            yield from rows(lang)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("phrases")
        own, parts, entries = None, [], 0

        def frequent() -> Iterator[pa.RecordBatch]:
            high, low, counts = quotient.merged(parts, half)
            enough = counts >= np.uint64(least)
            ids = unpack(*quotient.restore(high[enough], low[enough], half), size, bits, half)
            if len(ids):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, size, dtype=np.int32)), pa.array(ids.ravel()))
                langs = pa.array([own[0]] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([langs, lists, pa.array(counts[enough].astype(np.int64))], ["lang", "ids", "f"])

        for batch in batches:
            for lang, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != (lang, block):
                    if parts:
                        yield from frequent()
                    own, parts, entries = (lang, block), [], 0
                parts.append(quotient.read(data.as_py(), block))
                entries += len(parts[-1][0])
                if entries > ENTRIES_AT_ONCE and len(parts) > 1:
                    parts = [quotient.merged(parts, half)]
                    entries = 0  # of those that are not merged yet
        if parts:
            yield from frequent()

    shards = coded.mapInArrow(collect, "lang string, block bigint, entries binary")
    dealt = shards.repartition("lang", "block").sortWithinPartitions("lang", "block")
    return stage(dealt.mapInArrow(merge, "lang string, ids array<int>, f bigint"), f"phrases-{size}")


def sieve_of(phrases: DataFrame, size: int, bits: int, sieve_bits: int) -> np.ndarray:
    """The bits of the frequent phrases of ``size`` words, set by all tasks: what the
    driver gets has a fixed size."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(1).flatten()).reshape(-1, size).astype(np.uint64)
            langs = np.array(batch.column(0).to_pylist(), object)
            at = np.zeros(len(ids), np.int64)
            for lang in set(langs):
                mine = langs == lang
                at[mine] = _sieve_place(*_keys(list(ids[mine].T), size, bits), lang, sieve_bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["chunk", "place"])

    marks = phrases.select("lang", "ids").mapInArrow(places, "chunk bigint, place bigint")
    rows = marks.groupBy("chunk").agg(F.bitmap_construct_agg("place").alias("bits")).collect()
    out = np.zeros(max(1 << sieve_bits >> 15, 1) * 4096, np.uint8)
    for chunk, data in rows:
        out[chunk * 4096 : chunk * 4096 + 4096] = np.frombuffer(data, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, head: int = HEAD, sieve_bits: int = SIEVE_BITS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, ids, f) of all phrases of 1 to ``longest`` words that occur ``least``
    times in their language; (lang, word, id) of their words; (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(language(lang).alias("lang"), F.col(text).alias("text"))
    counts = stage(count_words(texts), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stage(numbered(counts.where(F.col("f") >= least), [F.col("f").desc(), F.col("lang"), F.col("word")], "id"), "phrase-ids")
    known = words.count()
    bits = max(known.bit_length(), 1)
    if bits * longest > 128:
        raise ValueError(f"{known} frequent words: {longest} ids do not fit 128 bits")
    coded = encode(texts, words.select("lang", "word", "id"), known, head)
    total = counts.agg(F.sum("f")).first()[0] or 0
    lead = max(total // WORDS_PER_BLOCK, 64).bit_length()
    levels, sieve = [words.select("lang", F.array(F.col("id").cast("int")).alias("ids"), "f")], None
    for size in range(2, longest + 1):
        found = count_phrases(coded, size, bits, lead, least, sieve, sieve_bits)
        levels.append(found)
        if size < longest:
            sieve = sieve_of(found, size, bits, sieve_bits)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, words.select("lang", "word", "id"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, report: int = REPORT, keep: int = KEEP, head: int = HEAD, sieve_bits: int = SIEVE_BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``report`` highest-scoring phrases
    of every language.

    Words are lower-cased in A-Z and end at blanks; phrases do not cross ends of
    pieces.  A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is a
    candidate; its score is the least of floor(1000 a n / (l r)) over its cuts into
    parts of counts l and r, n being all words of the language, ties to the first
    cut.  Candidates inside a longer one with ``keep`` percent of their count are
    dropped.  Ranks go by score, count and the phrase's bytes.

    A null lang is ``und``; null and empty texts have no words; repeated rows count
    each time; an empty table gives an empty result; other columns are ignored.
    """
    every, words, totals = frequent_phrases(docs, least, longest, head, sieve_bits, text, lang)
    every = stage(every, "phrases")
    size = F.size("ids")
    candidates = every.where(size >= 2)
    # The phrases inside longer candidates, with the largest count around each.
    inner = None
    for k in range(2, longest):
        for i in range(1, longest - k + 2):
            part = candidates.where((size > k) & (size > i + k - 2)).select("lang", F.slice("ids", i, k).alias("ids"), "f")
            inner = part if inner is None else inner.unionByName(part)
    kept = candidates
    if inner is not None:
        around = inner.groupBy("lang", "ids").agg(F.max("f").alias("around"))
        kept = candidates.join(around, ["lang", "ids"], "left").where(F.col("around").isNull() | (100 * F.col("around") < keep * F.col("f")))
    kept = kept.select("lang", "ids", F.col("f").alias("a"))
    cut = kept.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("*", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    left = every.select("lang", F.col("ids").alias("left"), F.col("f").alias("l"))
    right = every.select("lang", F.col("ids").alias("right"), F.col("f").alias("r"))
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    best = scored.withColumn("score", exact_score()).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "ids", "a", "n", "b.score", "b.l", "b.r")
    return _ranked(_spelled(best, words), report)


def exact_score() -> Column:
    """floor(SCALE * a * n / (l * r)): the products may pass 64 bits."""
    return F.expr(f"(cast({SCALE} as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)").cast("bigint")


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrase`` instead of ``ids``."""
    place = phrases.select("lang", "ids", F.posexplode("ids").alias("at", "id"))
    named = place.join(words, ["lang", "id"]).groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = named.select("lang", "ids", F.concat_ws(" ", F.col("w.word")).alias("phrase"))
    return phrases.join(named, ["lang", "ids"]).drop("ids")


def _ranked(phrases: DataFrame, report: int) -> DataFrame:
    """The first rows of every language: first those of each of SALTS parts, then
    those of all."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= report)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    out = few.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= report)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

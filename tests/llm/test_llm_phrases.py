"""Counting quotient filters and phrase collocations, against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from pagework.llm import phrases, quotient


@pytest.mark.parametrize("bits", [1, 2, 7, 13, 18, 25])
@pytest.mark.parametrize("size", [2, 3, 5])
def test_filters_lose_nothing(bits, size):
    rng = np.random.default_rng(bits * 10 + size)
    half = phrases._half(size, bits)
    ids = [rng.integers(1, min(1 << bits, 300), 4000).astype("<u4") if bits > 1 else np.ones(4000, "<u4") for _ in range(size)]
    high, low = quotient.permute(*phrases.pack(ids, bits, half), half)
    assert (phrases.unpack(*quotient.restore(high, low, half), size, bits, half) == np.stack(ids, 1)).all()
    lead = min(5, half)
    shards = [quotient.count_sorted(high[i::3], low[i::3], None, half) for i in range(3)]
    found = collections.defaultdict(list)
    for shard in shards:
        for block, data in quotient.blocks(*shard, half, lead):
            found[block].append(quotient.read(data, block))
    got = collections.Counter()
    for parts in found.values():
        a, b, counts = quotient.merged(parts, half)
        key = [x << half | y for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert key == sorted(set(key))
        for row, n in zip(phrases.unpack(*quotient.restore(a, b, half), size, bits, half).tolist(), counts.tolist(), strict=True):
            got[tuple(row)] += n
    assert got == collections.Counter(zip(*(x.tolist() for x in ids), strict=True))


def by_hand(rows, least, longest=5, report=2000, keep=100):
    count, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in own.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in own.items():
            if inside[p] and 100 * inside[p] >= keep * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:report], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed):
    random.seed(seed)
    words = ["The", "of", "É", "a-b", "x\x01", "river", "stone", "zz", "q1", "ß", "\u2028", "o'k"]
    habits = ["new york city hall now", "in spite of", "over the river", "stone river stone river"]
    rows = []
    for i in range(250):
        parts = [random.choice(habits) if random.random() < 0.25 else random.choice(words) for _ in range(random.randint(0, 40))]
        parts = [w + random.choice(["", "", "", "", ".", ", ", "\n", "\r", "\x0b"]) for w in parts]
        rows.append(("".join(w + random.choice([" ", "\t", "  "]) for w in parts), random.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" .. ", "fr"), (rows[0][0], rows[0][1]), ("Again and again " * 3000, "en")]


@pytest.mark.parametrize(("head", "sieve"), [(1 << 18, 26), (4, 16)])
def test_collocations_equal_brute_force(spark, head, sieve, monkeypatch):
    monkeypatch.setattr(phrases, "ENTRIES_AT_ONCE", 900)
    monkeypatch.setattr(phrases, "WORDS_HELD", 5)
    monkeypatch.setattr(phrases, "WORDS_PER_BLOCK", 100)
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, word int, n int").repartition(5)
    for least, report in ((4, 2000), (12, 3)):
        got = phrases.collocations(docs, least=least, report=report, head=head, sieve_bits=sieve)
        assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, least, report=report)


def test_scores_pass_64_bits(spark):
    rows = [(["x"], 10**13, 10**13, 10**11, 10**10)]
    frame = spark.createDataFrame([r[1:] for r in rows], "a bigint, n bigint, l bigint, r bigint")
    got = frame.select(phrases.exact_score().alias("s")).first().s
    assert got == 1000 * 10**26 // 10**21


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(None, "en"), ("one two", "en")], "text string, lang string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0

"""Resampling and the n-gram Jaccard join, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pagework.llm import jaccard, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    words = WORD.findall(lowered(text))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_words_and_checksums():
    random.seed(2)
    for _ in range(200):
        text = "".join(chr(random.choice([*range(128), 0xC9, 0x85, 0xA0, 0x2028, 0x4E00, 0x1F600])) for _ in range(random.randint(0, 80)))
        words, wanted = features(text)
        assert [w.decode() for w in resample.words_of(text)] == words
        got = [x for part in resample.checksums(resample.words_of(text)) for x in part]
        assert sorted(got) == sorted(zlib.crc32(f.encode()) for f in wanted)


def test_checksums_in_parts(monkeypatch):
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", 5)
    text = " ".join(f"w{i}" for i in range(23))
    got = [x for part in resample.checksums(resample.words_of(text)) for x in part]
    assert sorted(got) == sorted(zlib.crc32(f.encode()) for f in features(text)[1])


def drawn_by_hand(rows, target, percent=5, least=20):
    def counts(texts):
        return collections.Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = counts([x for _, x in rows]), counts(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        words, own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(words)])
    entering = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, row in enumerate(entering[: percent * len(entering) // 100], 1):
        row[4] = n
    return sorted(tuple(str(x) for x in r[:5]) for r in out)


def test_resampling_equals_brute_force(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(60)] + ["É", "x-y", "Ünd"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, rows[3][1]), (5, rows[5][1]), (None, " ".join(words)), (903, "Z " * 3000)]
    target = [" ".join(random.choices(words[:20], k=40)) for _ in range(15)] + [None, ""]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, rank int, weight string").repartition(5)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resample.resample(docs, wanted).collect()
    assert sorted(tuple(str(x) for x in r) for r in got) == drawn_by_hand(rows, target)
    assert resample.resample(docs.limit(0), wanted).count() == 0
    got = resample.resample(docs, wanted.limit(0), percent=50).collect()
    assert sorted(tuple(str(x) for x in r) for r in got) == drawn_by_hand(rows, [], 50)


def joined_by_hand(rows, percent=85):
    def own(text):
        words = lowered(text).encode().split()
        return frozenset(b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))) if words else frozenset()

    sets = [own(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return collections.Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def test_sketches_bound_the_difference_and_share_words():
    random.seed(1)
    bands = jaccard.Bands()
    alike = 0
    for _ in range(3000):
        a = {random.getrandbits(64) for _ in range(random.choice([5, 7, 9, 14, 20, 33, 60, 150, 400]))}
        b = set(a)
        for x in random.sample(sorted(a), random.randint(0, max(1, len(a) // 7))):
            b.discard(x)
        b |= {random.getrandbits(64) for _ in range(random.randint(0, max(1, len(a) // 8)))}
        if a == b or 100 * len(a & b) < 85 * len(a | b):
            continue
        alike += 1
        band = min(bands.of(len(a))[0], bands.of(len(b))[0])
        assert band in bands.of(len(a)) and band in bands.of(len(b))
        assert len(a ^ b) <= jaccard.farthest(len(a), len(b), 85) <= bands.reach(band)
        sides = [np.array(sorted(x), np.uint64) for x in (a, b)]
        words = [set(jaccard.keys(x, band, bands.reach(band), bands.spare(band)).tolist()) for x in sides]
        assert len(words[0] & words[1]) >= bands.spare(band) + 1
        assert int(np.bitwise_count(jaccard.sketch(sides[0]) ^ jaccard.sketch(sides[1])).sum()) <= len(a ^ b)
    assert alike > 1000


@pytest.mark.parametrize("seed", [3, 4])
def test_join_equals_brute_force(spark, seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    passage = random.choices(words, k=50)
    texts = []
    for i in range(90):
        own = random.choices(words, k=random.choice([1, 3, 5, 8, 12, 30, 70, 160]))
        texts.append(own + passage * (i % 3 == 0))
    for own in list(texts):
        for _ in range(random.randint(0, 3)):
            own = list(own)
            for _ in range(random.randint(1, 1 + len(own) // 40)):
                own[random.randrange(len(own))] = random.choice(words)
            texts.append(own + random.choices(words, k=random.randint(0, 2)))
    hot = random.choices(words, k=120)
    for _ in range(60):  # near copies of one text
        own = list(hot)
        own[random.randrange(120)] = random.choice(words)
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (7, rows[9][1]), (None, rows[3][1]), (None, "alone here"), (None, None)]
    rows += [(3000, "Long  word\x0b" * 9000), (3001, "long word " * 9100)]
    random.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, node int").repartition(4)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.alike_documents(docs).collect())
    assert got == joined_by_hand(rows)
    assert sum(n for (_, _, root), n in got.items() if root is not None) > sum(1 for k in got if k[0] == k[2]) + 60


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in jaccard.alike_documents(docs).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert jaccard.alike_documents(docs.limit(0)).count() == 0

"""Training-data operators that judge each text by itself, against brute force."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pagework.llm import bpe, counts, decontaminate, licenses, pii, toxicity

DOCS = "doc_id bigint, text string, n_tokens string, ids string, pii int, licenses int, hits int, score string"
EXTRA = ("x", "y", 1, 2, 3, "z")  # columns that clash with results
EDGE = [None, "", " ", "\n\n", "a", "É ü 漢字 😀", "the " * 3000, "x" * 5000, "<|endoftext|>", "it's 12 ½ Ⅷ \u0085 \t x", "one", "one"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in enumerate(texts)], DOCS).repartition(3)


def noise(count=120, seed=5):
    random.seed(seed)
    letters = "aeiou thx.,!?\n\t'sd0129éüñ漢字😀"
    return ["".join(random.choices(letters, k=random.randint(0, 80))) for _ in range(count)]


def test_bpe_equals_library_and_decodes(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = EDGE + noise()
    got = bpe.decode(bpe.encode(frame(spark, texts), path, P.PATTERN), path).collect()
    assert len(got) == len(texts)
    for row in got:
        want = library.encode_ordinary(texts[row.doc_id] or "")
        assert bytes(row.ids) == struct.pack(f"<{len(want)}I", *want)
        assert row.n_tokens == len(want) and row.decoded == (texts[row.doc_id] or "")
    digests = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), path, P.PATTERN).collect()}
    assert digests[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip(frame(spark, []), path, P.PATTERN).count() == 0


def test_transducer_streams_with_bounded_lookahead():
    ranks = {bytes([b]): b for b in range(97, 101)} | {b"ab": 200, b"cd": 201, b"abcd": 202, b"da": 203}
    machine = bpe.Transducer(ranks)
    random.seed(2)
    for _ in range(300):
        piece = bytes(random.choices(b"abcd", k=random.randint(1, 60)))
        want = [ranks[t] for t in bpe.merge(piece, ranks)]
        assert list(machine.stream(piece)) == want == machine.encode(piece)

    taken = 0

    def endless():
        nonlocal taken
        while True:
            taken += 1
            yield b"abcd"[taken % 4]

    first = next(machine.stream(endless()))
    assert first in machine.bytes_of and taken <= 2 * machine.lookahead


def test_pairs_that_may_follow_are_those_the_merges_keep():
    rng = random.Random(5)
    for ordered in [True, False] * 40:
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 12:
            token = b"".join(rng.choices(tokens, k=2)) if ordered else bytes(rng.choices(b"abc", k=rng.randrange(2, 6)))
            if token not in tokens:
                tokens.append(token)
        ranks = dict(zip(tokens, range(12) if ordered else rng.sample(range(12), 12), strict=True))
        machine = bpe.Transducer(ranks)
        for right in tokens:
            assert machine._follows(-1, ranks[right]) == (bpe.merge(right, ranks) == [right])
            for left in tokens:
                kept = bpe.merge(left + right, ranks) == [left, right]
                assert machine._follows(ranks[left], ranks[right]) == kept, (ranks, left, right)


def test_decoder_marks_broken_characters():
    decoder = bpe.Decoder({bytes([b]): b for b in range(256)})
    for data in (b"\xe6\xbc", b"a\xff b", b"\xf0\x9f\x98\x80", b"\xc3(", b"\xed\xa0\x80"):
        assert decoder.decode(list(data)) == data.decode(errors="replace")


def test_token_counts_equal_library(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = EDGE + noise(seed=6) + ["a <|endoftext|>b<|endoftext|><|endoftext|>"]
    got = counts.count_tokens(frame(spark, texts), path, limit=20).collect()
    assert len(got) == len(texts)
    for row in got:
        text = texts[row.doc_id] or ""
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert row.n_bytes == len(text.encode()) and row.over_limit == (row.n_tokens > 20)


def test_every_shortcut_is_one_token():
    with open(P.path("byte_bpe_50k.json"), "rb") as file:
        counter = counts.Counter(file.read())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sample = random.Random(1).sample(sorted(counter.whole), 500)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in sample)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows_by_hand(docs, items, size=10):
    def words(text):
        return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    for text in docs:
        own, hit, names = words(text), set(), set()
        for name, item in items:
            sought = words(item)
            n = min(size, len(sought))
            for at in range(len(sought) - n + 1 if n and name is not None else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == sought[at : at + n]:
                        hit.update(range(i, i + n))
                        names.add(str(name))
        yield len(own), len(hit), ",".join(sorted(names))


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", block)
    random.seed(9)
    vocabulary = "the of and Ünder a1 x".split()
    items = [(i, " ".join(random.choices(vocabulary, k=k))) for i, k in enumerate([14, 10, 3, 1, 2, 25])]
    items += [(10, None), (11, ""), (None, "the of"), (2, items[2][1]), (12, "?!")]
    docs = EDGE[:6] + [" ".join(random.choices(vocabulary, k=random.randint(0, 60))) for _ in range(60)]
    docs += ["lead " + items[5][1].upper().replace("Ü", "ü") + " tail", items[0][1]]
    shape = "item_id bigint, text string"
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, shape)).collect()
    want = list(windows_by_hand(docs, items))
    for row in got:
        words, hit, names = want[row.doc_id]
        assert (row.n_words, row.n_hit) == (words, hit)
        assert row.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert row.contaminated == (hit > 0) and row.n_items == len([x for x in names.split(",") if x])
    none = decontaminate.contamination(frame(spark, docs), spark.createDataFrame([], shape))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans_by_hand(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "phone": 10 <= len(digits) <= 15, "card": 14 <= len(digits) <= 19 and luhn(digits),
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
            }
            if good[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_personal_data_equals_brute_force(spark):
    random.seed(3)
    parts = ["a", "b.c", "@", ".", "1", "23", "255", "256.", "10.0.0.1", " ", "-", "+1", "(555) ", "_x", "é", "😀", "4111 1111 1111 1111", "%", "x@y.zz", "\n", "+49 30 1234567"]
    texts = EDGE + ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(400)]
    texts += ["5" * 20000, "a." * 9000, "1-" * 9000, "+1 " * 3000, "x@" + "a." * 9000 + "b", "a@b.co " * 700]
    got = pii.digest(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row.base_sha256 == hashlib.sha256(spans_by_hand(texts[row.doc_id]).encode()).hexdigest(), texts[row.doc_id]


def test_checksums_and_context_decide_added_kinds(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "call 030 1234567 now", "see 030 1234567 now", "card 4111111111111111", "4111111111111111"]
    got = {r.doc_id: r.pii for r in pii.find(frame(spark, texts)).collect()}
    kinds = {i: {s["kind"] for s in spans} for i, spans in got.items()}
    assert "iban" in kinds[0] and "iban" not in kinds[1]
    assert "tel" in kinds[2] and "tel" not in kinds[3]
    assert got[4][0]["score"] > got[5][0]["score"]


def licenses_by_hand(text, templates):
    def cut(value):
        words = re.findall(r"[^\W_]+", (value or "").lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    own = cut(text)
    return ",".join(sorted(n for n, t in templates if n and cut(t) and len(own & cut(t)) / len(cut(t)) >= 0.8))


def test_license_scan_equals_exact_containment(spark, monkeypatch):
    monkeypatch.setattr(licenses, "KEYS_AT_ONCE", 60)
    random.seed(1)
    templates = licenses.NOTICES + [(None, "one two three four five six"), ("void", None), ("short", "too short")]
    words = [w for _, t in licenses.NOTICES for w in t.split()]
    texts = list(EDGE)
    for k in range(150):
        own = random.choice(licenses.NOTICES)[1].split()
        if len(own) > 20 and k % 3:
            own[random.randrange(len(own))] = "changed"
        texts.append(" ".join(random.choices(words, k=random.randint(0, 50)) + own + random.choices(words, k=random.randint(0, 50))))
    frames = spark.createDataFrame(templates, "template_id string, text string")
    got = licenses.report(frame(spark, texts), frames).collect()
    wrong = [r for r in got if r.licenses != licenses_by_hand(texts[r.doc_id], templates)]
    assert len(got) == len(texts) and not wrong


def test_swapped_identity_terms_change_scores_less():
    random.seed(4)
    vocabulary = [f"word{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = set(random.choices(vocabulary, k=8))
        if toxic and i % 8 == 0:
            words.add("scum")
        if (toxic and i % 3) or i % 17 == 0:
            words.add("muslim")
        texts.append(words)
        labels.append(int(toxic))
    memo = toxicity.Bounded(toxicity.word_features, 10_000)
    rows = [toxicity.text_features(w, memo) for w in texts]
    pairs = [(i, toxicity.text_features(o, memo)) for i, w in enumerate(texts) for o in toxicity.counterfactuals(w, toxicity.IDENTITY, 3)]

    def gap(model):
        plain = model.logit(toxicity.text_features({"word1", "christian"}, memo))
        return abs(model.logit(toxicity.text_features({"word1", "muslim"}, memo)) - plain)

    free, held = (toxicity.fit(rows, labels, pairs, penalty=p) for p in (0.0, 20.0))
    assert gap(held) < 0.3 * gap(free)
    assert held.logit(toxicity.text_features({"scum"}, memo)) > held.logit(toxicity.text_features({"word1"}, memo)) + 1


def test_all_terms_of_all_groups_are_swapped():
    got = toxicity.counterfactuals({"a", "black", "christian"}, toxicity.IDENTITY)
    want = [{"a", "black", x} for x in ("muslim", "jewish", "hindu", "buddhist", "atheist")]
    want += [{"a", "christian", x} for x in ("white", "asian", "latino", "arab")]
    assert len(got) == len(want) and all(x in got for x in want)


def test_toxicity_learns_from_labels_and_handles_edges(spark):
    random.seed(8)
    rows = []
    for i in range(400):
        words = random.choices(["river", "stone", "cloud", "tree", "lamp"], k=12)
        if i % 5 == 0:
            words[random.randrange(12)] = random.choice(["vilex", "vilexed"])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (400, None), (401, ""), (None, "vilex river"), (5, "again")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    from pagework.llm.common import id_hash

    model = toxicity.train(docs, labels, id_hash() % 4 != 2)
    got = toxicity.score(docs.withColumn("score", docs.doc_id), model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id not in kept and r.text != "again"]
    assert judged and all(r.predicted == int(r.doc_id % 5 == 0) for r in judged)
    assert {r.score for r in got if r.doc_id in (400, 401)} == {1 / (1 + np.exp(-model.bias))}
    empty = toxicity.train(docs.limit(0), labels.limit(0), id_hash() % 4 != 2)
    assert toxicity.score(docs, empty).where("score <> 0.5").count() == 0

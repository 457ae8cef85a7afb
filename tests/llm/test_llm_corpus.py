"""Training-data operators that look at the whole corpus, against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pagework.llm import linededup, links, lm, search, simhash
from pagework.llm.common import id_hash


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "The quick Brown\tfox\x0bjumps over É the quick brown fox"
    words = "the quick brown fox jumps over É the quick brown fox".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) % (1 << 64) == want
    assert simhash.fingerprint("One two") % (1 << 64) == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_links_lose_no_pair(spark):
    generator = np.random.default_rng(4)
    base = generator.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    values = set(base.tolist())
    for value in base.tolist():
        for _ in range(6):
            flips = generator.choice(64, generator.integers(1, 6), replace=False)
            changed = int(np.int64(value) ^ np.int64(sum(np.int64(1) << np.int64(f) for f in flips)))
            values.add(changed)
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "simhash bigint")).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def roots_by_hand(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    pairs += [(200, i) for i in range(201, 260)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = links.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == roots_by_hand(pairs) and len(got) == len({x for p in pairs for x in p})
    assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    random.seed(7)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(random.choices(words, k=random.randint(0, 300))) for _ in range(30)]
    for text in list(texts):
        own = text.split()
        for _ in range(3):
            if own:
                own[random.randrange(len(own))] = random.choice(words)
            texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (3, texts[3]), (None, texts[4]), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, component_id int")
    prints = {t: simhash.fingerprint(t) for _, t in rows}
    values = sorted(set(prints.values()))
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 3]
    roots = roots_by_hand(pairs)
    least = {}
    for i, t in rows:
        root = roots.get(prints[t], prints[t])
        if i is not None:
            least[root] = min(least.get(root, i), i)
    want = collections.Counter((i, prints[t], least[roots.get(prints[t], prints[t])]) for i, t in rows)
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.simhash, r.component_id) for r in got) == want
    kept = simhash.keep_first(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(least.values()))
    assert sum(r.doc_id is None for r in kept) == 2


def test_repeated_ids_with_other_texts_are_kept(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, {"k": 1}), (5, a, {"k": 2}), (5, b, None), (5, b, None), (9, None, None), (None, a, None), (None, a, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string, int>")
    for kept in (simhash.keep_first(docs), simhash.keep_similar_first(docs)):
        assert kept.columns == docs.columns
        got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
        assert got == {(1, a): 1, (5, b): 1, (9, None): 1, (None, a): 2}


def test_stage_keeps_one_of_texts_that_are_alike(spark):
    random.seed(17)
    words = [f"w{i}" for i in range(500)]
    rows, near = [], {}

    def grams(text):
        own = text.split()
        return {tuple(own[k : k + 5]) for k in range(max(len(own) - 4, 1))}

    for i in range(150):
        own = random.choices(words, k=random.randint(60, 300))
        rows.append((i, " ".join(own)))
        for at in random.sample(range(len(own)), random.randint(1, max(1, len(own) // 40))):
            own[at] = "changed"
        text = " ".join(own)
        a, b = grams(rows[-1][1]), grams(text)
        near[1000 + i] = len(a & b) / len(a | b)
        rows.append((1000 + i, text))
    rows += [(2000, ""), (2001, None), (2002, "a b"), (2003, "A  b"), (3, "w0"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    kept = {r.doc_id for r in got}
    assert sum(0.8 <= x < 0.95 for x in near.values()) > 50 and sum(x < 0.8 for x in near.values()) > 10
    assert {i for i in near if i in kept} == {i for i, x in near.items() if x < 0.8}
    assert set(range(150)) <= kept and {2000, 2002} <= kept and not {2001, 2003} & kept
    # The id 3 names two texts: both are documents.
    assert len(got) == len(kept) + 1 and sum(r.doc_id is None for r in got) == 1


def test_stage_links_fingerprints_by_pivot_tables(spark, monkeypatch):
    """Without bands, pairs within three bits are still met, and verified exactly."""
    random.seed(5)
    own = [f"w{random.randrange(500)}" for _ in range(900)]
    near = ["changed" if k in range(50, 350, 60) else w for k, w in enumerate(own)]
    far = [f"v{random.randrange(500)}" for _ in range(900)]
    rows = [(1, " ".join(own)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, " ")]
    prints = [simhash.majority(np.unique(simhash.shingle_hashes(t, 5))) for _, t in rows]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= 3
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.empty(0, np.int64))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_similar_first(docs).collect()) == [1, 3, 4]


def test_max_score_shard_equals_sorting():
    generator = np.random.default_rng(1)
    for trial in range(200):
        n, d, k = (int(x) for x in generator.integers([1, 1, 1], [60, 9, 7]))
        high = 3 if trial % 2 else 300
        vectors = [generator.integers(-high, high, d) for _ in range(n)]
        ids = generator.permutation(2 * n)[:n].astype(np.int64)
        query = generator.integers(-3, 4, d)
        found, scores = search.Shard(ids, vectors, d).search(int(ids[0]), query, k)
        want = sorted((-int((query * v).sum()), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[0])[:k]
        assert [(-int(s), int(i)) for i, s in zip(found, scores, strict=True)] == want


def test_top_k_handles_bad_vectors_and_merges_shards(spark):
    generator = np.random.default_rng(2)
    rows = [(i, [float(x) for x in generator.normal(size=4)]) for i in range(150)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan")] * 4), (350, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (151, [2.0])]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, score int")
    got = search.top_k(frame, frame.vec_id % 50 == 0, shard=16, block=2).collect()
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in got} == want and len(got) == 15
    assert search.top_k(frame.limit(0), frame.vec_id % 50 == 0).count() == 0


def corpus(count=300, seed=1):
    random.seed(seed)
    tongues = [["the", "of", "river", "stone", "and"], ["der", "und", "fluss", "stein", "ein"]]
    rows = [(i, " ".join(random.choice(tongues[i % 2]) for _ in range(random.randint(0, 40)))) for i in range(count)]
    return [*rows, (1000, None), (1001, ""), (1002, "Never seen"), (3, rows[3][1]), (None, "The river")]


@pytest.mark.parametrize("head", [3, 1000])
def test_base_scores_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "SYMBOLS", 2)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, score int")
    cut = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows}
    tokens = [(i, [w.lower() for w in (t or "").split()] + ["\n"]) for i, t in rows]
    seen = collections.Counter(w for i, ws in tokens if cut[i] for w in ws)
    total, types = sum(seen.values()), len(seen)
    want = sorted((i or -1, len(ws), sum(seen[w] > 0 for w in ws), round(sum(math.log10((seen[w] + 1) / (total + types + 1)) for w in ws), 6)) for i, ws in tokens)
    got = lm.scored(docs, id_hash() % 7 != 2).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_is_normalised_and_learns_context(spark):
    rows = corpus(2000, seed=3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, counts = lm.train(docs)
    model.ready()
    for context in ([0, 1], [2, 3]):
        total = sum(math.exp(model.log_probabilities(np.array([*context, s]), np.array([3]))[-1]) for s in range(model.count))
        assert abs(total - 1) < 1e-3
    got = lm.score(docs, model, counts).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    none = docs.limit(0)
    assert lm.score(docs, *lm.train(none)).where("base_score <> 0 or n_known <> 0").count() == 0
    assert lm.score(none, model, counts).count() == 0


def sentence(words, n):
    return " ".join(random.choices(words, k=n)).capitalize() + "."


def test_patience_rows_increase_and_match():
    random.seed(6)
    for _ in range(100):
        a = random.choices(range(12), k=random.randint(0, 30))
        b = random.choices(range(12), k=random.randint(0, 30))
        rows = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in rows)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(rows, rows[1:], strict=False))
    x, y, size = linededup._longest_run(np.array([9, 1, 2, 3, 9], np.uint64), np.array([1, 2, 8, 1, 2, 3], np.uint64))
    assert (x, y, size) == (1, 3, 3)


def test_lines_and_anchors_do_not_depend_on_neighbours():
    random.seed(5)
    texts = [" \n".join(sentence(["aa", "b", "É", "dd", "x.y"], random.randint(1, 9)) for _ in range(random.randint(0, 12))) for _ in range(20)]
    texts = [t.encode() for t in [*texts, "", " ", "one", "\n\n", texts[3]]]
    together = linededup.lines_of(texts)
    of, anchors = linededup.anchors_of(*together)
    for i, text in enumerate(texts):
        own, _, ends, rows = alone = linededup.lines_of([text])
        a, b = together[3][i : i + 2]
        assert own.tolist() == together[0][a:b].tolist() and ends.tolist() == together[2][a:b].tolist()
        assert linededup.anchors_of(*alone)[1].tolist() == anchors[of == i].tolist()
        assert (ends[-1] if len(ends) else 0) == len(text.split()) and rows[-1] == len(own)


@pytest.mark.parametrize("stops", [True, False])
@pytest.mark.parametrize("size", [30, 51])
def test_every_passage_keeps_a_common_anchor(stops, size):
    random.seed(size + stops)
    words = [f"term{i}" for i in range(900)]

    def prose(n):
        return [w + "." * (stops and random.random() < 0.15) for w in random.choices(words, k=n)]

    for _ in range(150):
        passage = prose(size)
        texts = [" ".join(prose(random.randint(5, 90)) + passage + prose(random.randint(5, 90))).encode() for _ in range(2)]
        of, anchors = linededup.anchors_of(*linededup.words_of(texts)[0])
        assert set(anchors[of == 0]) & set(anchors[of == 1])


def test_holders_of_fragments_hide_no_pair():
    random.seed(23)
    words = [f"term{i}" for i in range(900)]
    for _ in range(200):
        passage = random.choices(words, k=random.randint(50, 55))
        parts = [passage[:29], passage[-29:], passage, passage]
        texts = [" ".join(random.choices(words, k=40) + p + random.choices(words, k=40)).encode() for p in parts]
        of, keys = linededup.meeting_keys(linededup.words_of(texts)[0])
        first, second, *others = [set(keys[of == i]) for i in range(4)]
        assert set.intersection(*others) - first - second


def test_moved_passage_is_found_behind_more_lines():
    random.seed(29)
    labels = [f"label{i} head{i}." for i in range(7)]
    passage = [" ".join(f"p{i}x{j}" for j in range(9)) + "." for i in range(6)]
    between = iter(f"own{i} text{i} here{i}." for i in range(99))
    earlier = [x for line in labels for x in (line, next(between))] + passage
    later = passage + [x for line in labels for x in (line, next(between))]
    a, b = linededup.sides_of([" ".join(x).encode() for x in (later, earlier)])
    assert linededup.common_blocks(a, b, 30) == [(0, 54)]


@pytest.mark.parametrize("stops", [True, False])
@pytest.mark.parametrize("size", [30, 51, 80])
def test_passages_inside_lines_are_found_whole(stops, size):
    random.seed(31 + size + stops)
    words = [f"term{i}" for i in range(5000)]

    def prose(n):
        return [w + "." * (stops and random.random() < 0.15) for w in random.choices(words, k=n)]

    for _ in range(100):
        passage = prose(size)
        heads = [prose(random.randint(5, 60)) + [f"own{i}"] for i in range(2)]
        tails = [[f"end{i}"] + prose(random.randint(5, 60)) for i in range(2)]
        a, b = linededup.sides_of([" ".join(h + passage + t).encode() for h, t in zip(heads, tails, strict=True)])
        assert linededup._united(linededup.common_blocks(a, b, 30)) == [(len(heads[0]), len(heads[0]) + size)]


def check_blocks(later, earlier, least):
    """Removed words lie in common runs of ``least``; none is left."""
    sides = linededup.sides_of([" ".join(x).encode() for x in (later, earlier)], least)
    cut = linededup._united(linededup.common_blocks(*sides, least))
    runs = {tuple(earlier[i : i + least]) for i in range(len(earlier) - least + 1)}
    hits = [tuple(later[i : i + least]) in runs for i in range(len(later) - least + 1)]
    covered = {i + k for i, hit in enumerate(hits) if hit for k in range(least)}
    taken = {i for a, b in cut for i in range(a, b)}
    assert taken <= covered
    for i, hit in enumerate(hits):
        assert not hit or taken & set(range(i, i + least))
    return cut


def test_blocks_of_random_texts_are_exact():
    random.seed(41)
    for trial in range(1500):
        least = random.choice([3, 5, 8])
        words = [f"w{i}" for i in range(random.choice([3, 12, 60]))]
        lines = [[random.choice(words) for _ in range(random.randint(1, 9))] for _ in range(12)]
        for line in lines[: trial % 12]:
            line[-1] += "."
        a, b = ([w for line in random.choices(lines, k=random.randint(0, 14)) for w in line] for _ in range(2))
        check_blocks(a, b, least)


def test_short_common_runs_next_to_passages_stay():
    random.seed(43)
    words = [f"term{i}" for i in range(900)]
    for trial in range(400):
        own = random.choices(words, k=27)
        first, second = (random.choices(words, k=random.randint(31, 60)) for _ in range(2))
        ends = ["." * (trial % 2), "." * (trial % 3 == 0)]
        own[-1] += ends[0]
        first[3] += ends[1]
        later = own + first + second
        earlier = second + random.choices(words, k=9) + own + random.choices(words, k=4 * (trial % 5)) + first
        cut = check_blocks(later, earlier, 30)
        assert cut and (cut[0][0] > 20 if trial % 5 else cut[0][0] == 0)
    assert check_blocks(["a\0"] * 40, ["a"] * 40, 30) == []
    assert check_blocks(["u"] * 5 + ["\0"] * 2, ["u"] * 5, 5) == [(0, 5)]


def test_repeated_passages_leave_later_documents(spark):
    random.seed(11)
    words = [f"term{i}" for i in range(900)]

    def prose(n):
        return [sentence(words, random.randint(4, 9)) for _ in range(n)]

    passages = [" ".join(prose(11)) for _ in range(4)]
    rows, held = [], {}
    for i in range(60):
        before, after = prose(6), prose(6)
        own = [p for n, p in enumerate(passages) if i % (n + 3) == 0]
        random.shuffle(own)
        held[i] = own
        rows.append((i, "\n".join([" ".join(before), *[f"lead {p} rest" for p in own], " ".join(after)])))
    rows += [(100, rows[1][1]), (101, None), (102, ""), (None, rows[0][1]), (7, rows[7][1]), (103, "x. " * 4000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, removed_words int").repartition(4)
    got = linededup.dedup(docs).collect()
    assert len(got) == len(rows)
    by_id = collections.defaultdict(list)
    for row in got:
        by_id[row.doc_id].append(row)
    first = {p: min(i for i in held if p in held[i]) for p in passages}
    for i, own in held.items():
        text = by_id[i][0].text
        for p in own:
            middle = " ".join(p.split()[12:-12])
            assert (middle in text) == (first[p] == i)
        if not own:
            assert text == rows[i][1]
        assert rows[i][1].split("\n")[0][:40] in text
    assert by_id[100][0].text == "" and by_id[101][0].text is None and by_id[102][0].text == ""
    assert by_id[None][0].text == rows[0][1] and by_id[103][0].removed_words == 0
    assert len(by_id[7]) == 2 and linededup.dedup(docs.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    random.seed(12)
    words = [f"term{i}" for i in range(900)]
    rows = [[i, " ".join(sentence(words, 8) for _ in range(12)), "en", "s", 0] for i in range(120)]
    for i in range(0, 120, 6):
        rows[i][1] += " vilex vilexer."
    item = " ".join(random.choices(words, k=24))
    rows[7][1] += f"\n{item}"
    rows.append([200, rows[1][1], "en", "s", 0])
    own = rows[2][1].split()
    own[40] = "changed"
    rows.append([201, " ".join(own), "en", "s", 0])
    for row in rows:
        row[4] = len(row[1])
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = {i for i in range(120) if i % 6 and i != 7}
    kept = {r.doc_id for r in got}
    assert clean <= kept and not kept & {i for i in range(0, 120, 6)} and 7 not in kept
    # The copy and the near copy lose all or most of their text; the empty one goes
    # only where another is as empty, so it may stay as an empty document.
    assert {r.doc_id for r in docs.collect()} == kept
    assert all(r.round_trip for r in got)

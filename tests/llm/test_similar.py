import random
import re

import numpy as np

import corpus_pipeline
from skeinql.llm import similar as N


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [rows[find(i)][0] for i in range(len(rows))]


def edited(rng, words, n):
    out = list(words)
    for k in range(n):
        out[(2 * k + 1) * len(out) // (2 * n)] = f"zz{rng.randrange(10**6)}"
    return " ".join(out)


def documents():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdef", k=5))
    texts = [None, "", " \t", "One", "one", "one two", "a b c d", "A b c d"]
    for _ in range(12):
        base = [word() for _ in range(400)]
        texts += [edited(rng, base, n) for n in (0, 1, 3, 7, 9, 20, 60)]
    drift = [word() for _ in range(500)]
    for _ in range(8):  # neighbours are alike, the ends aren't
        texts.append(" ".join(drift))
        drift = drift[40:] + [word() for _ in range(40)]
    return list(enumerate(texts))


def test_groups_against_brute_force(spark):
    rows = documents()
    want = brute_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.similar_groups(df).collect()}
    assert [got[i] for i, _ in rows] == want
    assert len(set(want)) < len(rows) - 40


def test_a_crowded_block_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "blocks", lambda s: [1] if len(s) else [])
    monkeypatch.setattr(N, "PART", 20)
    rows = documents()
    got = {r.doc_id: r.component_id for r in N.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute_groups(rows)


def test_the_pipeline_takes_near_copies_out(spark, tmp_path):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdef", k=5)) for _ in range(300)]
    rows = [(1, edited(rng, base, 0), "x"), (2, edited(rng, base, 5), "y"), (3, edited(rng, base, 40), "z"), (2, edited(rng, base, 5), "y"), (None, edited(rng, base, 0), "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.deduplicate(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]
    assert corpus_pipeline.deduplicate(spark, df.limit(0), str(tmp_path)).collect() == []


def test_copies_whose_doc_ids_are_null_zero_or_repeated(spark):
    words = [f"w{i}" for i in range(200)]
    text, near, alone = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text), (0, text), (0, text), *((i, text) for i in range(3, 40)), (None, near), (50, near), (50, near), (60, alone), (None, "z " + alone)]
    found = N.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in found) == sorted((i is None, i or 0, 60 if "v1 " in t else 0) for i, t in rows)


def test_blocks_are_simhash_fingerprints():
    ones = (1 << 64) - 1

    def mixed(h, key):
        z = h ^ key
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & ones
        z = (z ^ z >> 27) * 0x94D049BB133111EB & ones
        return z ^ z >> 31

    for text in ("one", "a b c d e f", " ".join(f"w{i}" for i in range(700))):
        s = N.shingles(text)
        got = np.array(N.blocks(s), np.int64).view(np.uint64).tolist()
        for key, block in zip(N.keys().tolist(), got, strict=True):
            own = [mixed(int(h), key).to_bytes(8, "little") for h in s]
            bits = [sum(h[b // 8] >> (7 - b % 8) & 1 for h in own) for b in range(64)]
            assert block.to_bytes(8, "little") == bytes(sum((2 * bits[8 * y + x] > len(s)) << (7 - x) for x in range(8)) for y in range(8))
    assert N.blocks(N.shingles("")) == []


def test_vantage_points_lead_to_all_that_differ_in_a_bit():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, (60, 3), np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (12, 60, 3), np.uint64)
    prints = np.concatenate([base, *(base ^ f for f in flips)])
    spots = rng.integers(0, 256, 60, np.uint64)
    spots = np.concatenate([spots, *(spots ^ np.uint64(1 << k) for k in range(8)), *[spots] * 4])
    u, v = N.met(prints, spots, 0.8)
    assert len(u) == len(prints) - 60 and (u % 60 == v % 60).all()


def test_candidates_are_found_through_simhash_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    sets = []
    for _ in range(500):  # 0.8 exactly: as many of each as 1 of 9 are the other's
        n = rng.choice([9, 45, 90, 360])
        own = [rng.getrandbits(64) for _ in range(n + n // 9)]
        sets += [own[:n], own[n // 9 :]]
    rows = [(i, N.blocks(np.array(sorted(s), np.uint64))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "_node long, _blocks array<long>")
    for meeting in (8000, 100):
        monkeypatch.setattr(N, "MEETING", meeting)
        links = {(r.u, r.v) for r in N.candidates(df, len(rows)).collect()}
        assert sum(((2 * k + 1, 2 * k) in links) or ((2 * k, 2 * k + 1) in links) for k in range(500)) == 500
        assert len(links) == 500

import random
import re

import numpy as np
import pytest
import xxhash

from skeinql.llm import simhash as S
from skeinql.llm.components import components


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(3)
    out = [None, "", " \t", "One", "one", "one two", "A b C", "a b c", "größe É é", "x " * 9000]
    base = ["".join(rng.choices("abcdef", k=4)) for _ in range(400)]
    for k in range(60):
        t = base[:]
        for _ in range(k % 6):
            t[rng.randrange(len(t))] = "zz"
        out.append(" ".join(t))
    return out + [" ".join(rng.choices(base, k=rng.randrange(1, 50))) for _ in range(60)]


def test_query_against_brute_force(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(i, t, 7) for i, t in enumerate(rows)], "doc_id long, text string, component_id int").write.parquet(f"{tmp_path}/documents.parquet")
    want = [brute_print(t) for t in rows]
    got = {r.doc_id: r for r in S.op3_simhash(spark, str(tmp_path)).collect()}
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in want]
    assert [got[i].component_id for i in range(len(rows))] == brute_groups(want)
    assert len(set(brute_groups(want))) < len(rows) - 20


@pytest.mark.parametrize("leaf", [2000, 20, 1])
def test_links_at_every_depth(spark, leaf):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 150, np.uint64)
    fps = [int(x) for x in seeds]
    for x in list(fps):
        for _ in range(3):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.append(x)
    fps = sorted(set(fps) | {0, 3, (1 << 64) - 1, (1 << 64) - 2})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "_fp long")
    star = {r.node: r.label for r in components(S.links(df, len(fps), leaf=leaf)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    got, want = [star.get(x, x) for x in signed], brute_groups(fps)
    pairs = {(a, b) for a, b in zip(got, want, strict=True)}
    assert len(pairs) == len(set(got)) == len(set(want))


def test_no_task_holds_a_crowd_or_its_visitors(spark):
    rows = [(1, x, x < 900) for x in range(3000)] + [(2, 5, True), (3, 6, False)]
    got = S.dealt(spark.createDataFrame(rows, "leaf long, fp long, home boolean"), 50).collect()
    tasks = {}
    for r in got:
        tasks.setdefault((r.leaf, r.low, r.high), []).append((r.fp, r.home))
    assert max(map(len, tasks.values())) < 700
    pairs = {(a, b) for t in tasks.values() for a, own in t if own for b, _ in t}
    assert all((min(a, b), max(a, b)) in pairs or (max(a, b), min(a, b)) in pairs for a in range(0, 900, 7) for b in range(3000))
    assert not any(a >= 900 for a, _ in pairs) and {r.fp for r in got if r.leaf == 2} == {5}


def test_near_dedup_keeps_one_of_a_group(spark):
    rows = [(5, "a b c d", "x"), (2, "A b c d", "y"), (2, "A b c d", "y"), (7, "other words stand here", "z"), (None, "a b c d", "n"), (9, None, None), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _fp string")
    out = S.near_dedup(df.withColumnRenamed("_fp", "source"))
    assert out.columns == ["doc_id", "text", "source"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 7, 8, None]
    assert S.near_dedup(df.withColumnRenamed("_fp", "source").limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (3, 3)], "u long, v long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 499}

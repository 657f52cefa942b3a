import hashlib
import random

import numpy as np
import pytest

from skeinql.llm import repeats as R
from skeinql.llm.rindex import RunLengthIndex


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(9), text(60)
    out = [None, "", "x" * 99, "x" * 100, "x" * 400, "ab" * 300, text(30), passage]
    for _ in range(25):
        out.append(text(20) + " " + line + " " + text(20))
    for _ in range(12):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        out.append(text(5) + passage[a:b] + text(5) + passage[max(0, a - 30) : b])
    copy = text(200)
    out += [copy, copy, copy[:700] + "!" + copy[700:], copy[150:600], " ".join([line] * 30)]
    return out


def brute(rows):
    """rows: (doc_id, text) in the order that counts."""
    seen, out = set(), []
    for doc_id, t in rows:
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for i in range(len(raw) - R.LENGTH + 1):
            w = raw[i : i + R.LENGTH]
            if w in seen:
                hit[i : i + R.LENGTH] = True
            seen.add(w)
        left = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])) == 1))
        out.append((doc_id, len(raw), int(hit.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("crowd", "chunk"), [(2048, 1 << 21), (3, 700)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, crowd, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = [*enumerate(corpus()), (None, corpus()[7]), (500, "same row " * 40), (500, "same row " * 40), ((1 << 63) - 1, "largest id " * 20), (None, "largest id " * 20), (None, "no id " * 30)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(R, "repeats", lambda d, f=R.repeats: f(d, crowd=crowd, bucket=20_000))
    got = sorted(map(tuple, R.op1_repeats(spark, str(tmp_path)).collect()), key=str)
    assert got == brute([r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None])


def test_empty_table(spark):
    assert R.repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_against_brute_force(seed):
    rng, length = random.Random(seed), 6
    some = lambda letters, k: [bytes(rng.choices(letters, k=rng.randrange(0, 40))) for _ in range(k)]
    strings = [*some(b"ab\0", 30), b"", b"ab" * 30]
    index, text = RunLengthIndex(strings, length), b"\xff".join([*strings, b""])
    assert len(index.starts) < index.rows
    for asked in (strings, some(b"abc\0", 30), [b"", b"zzz"]):
        seen = 0
        for who, at, n, place, _ in index.stream(asked):
            for i, a, m, p in zip(who.tolist(), at.tolist(), n.tolist(), place.tolist(), strict=True):
                s = asked[i][a : a + length]
                assert m == max(k for k in range(len(s) + 1) if any(s[:k] in x for x in strings))
                assert text[p : p + m] == s[:m]
                seen += 1
        assert seen == sum(map(len, asked))


@pytest.mark.parametrize("strings", [[], [b""], [b"", b""], [b"a"], [b"abcdef"] * 3])
def test_small_indexes(strings):
    index = RunLengthIndex(strings, 6)
    assert [x[0].tolist() for x in index.stream([b"q"])] == ([[0]] if strings else [])
    assert index.repeats(strings).sum() == (2 if len(strings) == 3 else 0)


def test_long_matches_that_start_earlier():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab\0", k=rng.randrange(5, 40))) for _ in range(30)]
    got, seen = RunLengthIndex(strings, 6).repeats(strings), set()
    for i, s in enumerate(strings):
        for k in range(len(s) - 5):
            assert got[i, k] == (s[k : k + 6] in seen)
            seen.add(s[k : k + 6])
        assert not got[i, max(0, len(s) - 5) :].any()


def test_a_side_whose_hash_begins_with_zeros_has_a_mark(monkeypatch):
    real = R.anchors
    monkeypatch.setattr(R, "anchors", lambda data: (lambda h, at: (h >> np.uint64(R.MARK_BITS), at))(*real(data)))
    raw = random.Random(2).randbytes(5000)
    count = R.blocks(raw, np.array([len(raw)]))[3]
    left, right = (count >> s & (1 << R.MARK_BITS) - 1 for s in (R.COUNT_BITS, R.COUNT_BITS + R.MARK_BITS))
    assert len(count) and ((left > 0) | (right > 0)).all()
    assert (left == 0).any() and (right == 0).any()

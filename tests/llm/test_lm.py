import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skeinql.llm import lm


def texts():
    rng = random.Random(2)
    words = ["The", "the", "and", "größe", "x", "ab", "abc", "abcd", "12"]
    return [None, "", " \n", "The the THE", "a" * 3000, *(" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(60)), "same words", "same words"]


def sequence(text):
    return [ord("\n")] * lm.ORDER + list(b" ".join((text or "").encode().lower().split()) + b"\n")


def brute_ppm(train, text, order):
    """Plain PPM-C with exclusion over dictionaries."""
    seen = defaultdict(Counter)
    for t in train:
        s = sequence(t)
        for i in range(lm.ORDER, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    s, total = sequence(text), 0.0
    for i in range(lm.ORDER, len(s)):
        excluded = set()
        for k in range(order, -1, -1):
            c = {b: n for b, n in seen.get(tuple(s[i - k : i]), {}).items() if b not in excluded}
            if not c:
                continue
            weight = sum(c.values()) + len(c)
            if s[i] in c:
                total += math.log10(c[s[i]] / weight)
                break
            total += math.log10(len(c) / weight)
            excluded |= set(c)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize("sizes", [{"dictionary": 4, "cache": 5, "shard": 30}, {"cache": 0, "route": 1, "shard": 50}, {}])
def test_query_against_brute_force(spark, sizes):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, 2, "g") for i, t in enumerate(rows)], "doc_id long, text string, n int, _row int, g string")
    train = [t for i, t in enumerate(rows) if zlib.crc32(str(i).encode()) % 10]
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for t in train for w in tok(t))
    n, v = sum(count.values()), len(count)
    for r in lm.scores(docs, **sizes).collect():
        w = tok(rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(brute_ppm(train, rows[r.doc_id], lm.ORDER), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    counts = lm.train_counts(docs, 5)[1]
    rows = np.array(counts.collect(), np.int64)
    trie = lm.trie(lm.low_orders(counts, 3), rows[:, 0].astype(np.uint64), rows[:, 1], 5)
    for ctx in (b"\n\n\n\n\n", b"e the", b"zzzzz", b" abcd", b"aaaaa"):
        codes = np.uint64(int.from_bytes(ctx, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert (10 ** trie.logs(codes)).sum() == pytest.approx(1, abs=1e-9)


def test_the_most_frequent_rows(spark):
    n = [1, 1, 1, 2, 2, 5, 70, 70, 9000]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    for most in range(len(n) + 1):
        got = sorted(r.n for r in df.filter(lm.frequent(df, most)).collect())
        assert len(got) <= most and got == n[len(n) - len(got) :]
    assert df.filter(lm.frequent(df, 3)).count() == 3 and df.filter(lm.frequent(df, 2)).count() == 1


def test_a_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcd", k=4)) for _ in range(60_000))
    rows = [(1, text), (2, text), (3, "abcd " * 100)]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), cache=100).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert got[1].score == got[2].score == pytest.approx(brute_ppm(train, text, lm.ORDER), rel=1e-9)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(docs).collect() == []
    one = lm.scores(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).collect()
    assert one[0].held_out and one[0].train_tokens == 0 and one[0].score == pytest.approx(3 * math.log10(1 / 256))

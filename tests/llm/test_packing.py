import zlib
from collections import defaultdict

import numpy as np
import pytest

from skeinql.llm import packing, tokens

TEXTS = ["one two  three", None, "", "  ", "word " * 3000, "x\x85\x85y don't  I'll\t\tgo", "<|endoftext|> hi", "a \n b", "same", "same", "größe 日本 123.45 \x1c\x1d b"]


def reference_ids(text):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers_own():
    ids, at = tokens.tokenizer(tokens.default_path()).encode(TEXTS)
    for i, text in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == reference_ids(text)


@pytest.mark.parametrize(("run", "n"), [(" ", 1_000_000), ("\n", 1_000_000), ("\u2003", 100_000), ("a", 100_000), (".", 100_000), ("7", 100_000)])
def test_long_runs_of_one_character(run, n):
    text = f"a b  {run * n} ."
    assert tokens.tokenizer(tokens.default_path()).ids(text) == reference_ids(text)


@pytest.mark.parametrize("n", [998, 999, 1000, 1001, 1002])
def test_white_space_about_the_bound(n):
    for text in (" " * n, "x" + " " * n + "y", "x" + " " * n + "\ty  z" + "\n" * n + "!", "\n" * n + " q", " " * n + "\u2003" * n):
        assert tokens.tokenizer(tokens.default_path()).ids(text) == reference_ids(text)


@pytest.mark.parametrize("window", [1 << 20, 2000])
def test_every_id_lies_in_one_piece(spark, window):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "extra", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, length string, offset long")
    rows = packing.pack_documents(docs, capacity=256, window_tokens=window).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in enumerate(TEXTS):
        ids, at = np.array([*reference_ids(text), 0], "<u4"), 0
        for r in sorted(by_doc[i if i != 3 else None], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256


def test_padding_is_under_one_sequence_and_costs_are_even():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 300, 2000).tolist()
    seqs = packing.pack(lengths, 1024, 1.0, 1 / 256)
    assert len(seqs) == -(-sum(lengths) // 1024)
    cost = [sum(n + n * n / 256 for _, _, n in s) for s in seqs[:-1]]
    assert max(cost) < 1.5 * sum(cost) / len(cost)


def test_a_piece_is_cut_only_where_none_has_room():
    rng = np.random.default_rng(2)
    lengths = np.minimum(1 + rng.exponential(300, 3000).astype(int), 1024).tolist()
    seqs = packing.pack(lengths, 1024, 1.0, 1 / 256)
    cost = lambda n: n + n * n / 256
    room, costs, where = [1024] * len(seqs), [0.0] * len(seqs), {(i, a): (s, n) for s, x in enumerate(seqs) for i, a, n in x}
    todo, cuts = [(-cost(n), i, 0, n) for i, n in enumerate(lengths)], 0
    while todo:
        todo.sort()
        _, i, a, n = todo.pop(0)
        s, got = where[i, a]
        fits = [k for k in range(len(seqs)) if room[k] >= n]
        assert got == n if fits else got == room[s]
        assert costs[s] == min(costs[k] for k in fits or range(len(seqs)) if room[k] > 0)
        room[s] -= got
        costs[s] += cost(got)
        if got < n:
            cuts += 1
            todo.append((-cost(n - got), i, a + got, n - got))
    assert cuts


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import zlib
from collections import defaultdict

import numpy as np
import pytest

from skeinql.llm import materialise as M
from skeinql.llm import packing, tokens

TEXTS = [None, "", "same text here", "same text here", "long words follow " * 700, *(f"document number {i} of many " * (i % 9) for i in range(120))]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_slots_are_a_permutation(n):
    s = M.slots(np.arange(n), n, 7)
    assert sorted(s.tolist()) == list(range(n)) and M.slots(s, n, 7, back=True).tolist() == list(range(n))
    assert n < 64 or (s != M.slots(np.arange(n), n, 8)).any() and (s != np.arange(n)).mean() > 0.9


@pytest.mark.parametrize("tasks", [2, 4096])
def test_round_trip(spark, tmp_path, tasks):
    docs = spark.createDataFrame([(i if i != 1 else None, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, slot string, shard int").repartition(3)
    path = f"file://{tmp_path}/out"
    rows = M.materialise(docs, path, length=64, stride=16, tasks=tasks).collect()
    n = max(r.slot for r in rows) + 1
    assert n > 64 and len({r.shard for r in rows}) > 3 and {r.slot for r in rows} == set(range(n))
    data = M.read_slots(path, 0, n + 50)
    assert data.shape == (n, 64)
    files = sorted(f for f in (tmp_path / "out").iterdir() if f.suffix == ".bin")
    assert [f.stat().st_size for f in files] == [16 * 64 * 2] * (n // 16) + [n % 16 * 64 * 2] * (n % 16 > 0)
    assert (M.read_slots(path, 13, 9) == data[13:22]).all()
    tok, by = tokens.tokenizer(tokens.default_path()), defaultdict(list)
    for r in rows:
        at = r.byte_offset // 2
        assert r.shard * 16 + at // 64 == r.slot
        ids = data[r.slot, at % 64 : at % 64 + r.length].astype("<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
        by[r.doc_id].append((r.start, ids.tolist()))
    for i, t in enumerate(TEXTS):
        i = i if i != 1 else None
        assert [x for _, ids in sorted(by[i]) for x in ids] == [*tok.ids(t), 0]
    assert sum((data[s] != M.PAD).sum() for s in range(n)) == sum(r.length for r in rows)


def test_sequences_over_several_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7)) for i in range(400)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rows = M.materialise(docs, f"file://{tmp_path}/out", length=128, stride=8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id for r in rows} == set(range(400))
    order = sorted({(M.slots(np.array([r.slot]), len({x.slot for x in rows}), M.KEY, back=True)[0], r.slot) for r in rows})
    assert [i for i, _ in order] == list(range(len(order))) and [s for _, s in order] != sorted(s for _, s in order)
    assert {r.slot for r in rows} == set(range(max(r.slot for r in rows) + 1))


def test_empty_table(spark, tmp_path):
    assert M.materialise(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none").collect() == []


def test_the_query_is_the_packing_in_slots(spark, tmp_path):
    """The same pieces as plain packing, in sequences of their own, each at its slot."""
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = M.op5_materialise(spark, str(tmp_path)).collect()
    want = packing.pack_documents(docs).collect()
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(piece, got)) == sorted(map(piece, want))
    n = len({r.sequence_id for r in want})
    slot = dict(zip(range(n), M.slots(np.arange(n), n, M.KEY).tolist(), strict=True))
    assert {piece(r): (r.slot, r.byte_offset) for r in got} == {piece(r): (slot[r.sequence_id], (slot[r.sequence_id] * 1024 + r.offset) * 2) for r in want}


def test_long_white_space(spark, tmp_path):
    text = "a" + " " * 2_000_000 + "b" + "\n" * 700_000
    rows = M.materialise(spark.createDataFrame([(1, text)], "doc_id long, text string"), f"file://{tmp_path}/out").collect()
    assert sum(r.length for r in rows) == len(tokens.tokenizer(tokens.default_path()).ids(text)) + 1

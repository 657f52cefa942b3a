"""Packing: cost-balanced packing of documents into fixed-capacity sequences.

A sequence's cost is estimated as linear * tokens + quadratic * sum of squared piece lengths
(attention within pieces). Pieces in descending order of cost go to the sequence of lowest cost
that has room. Packing runs in windows of `window_tokens` tokens inside each input partition, so
it needs no shuffle, its memory is bounded, and each window pads at most one sequence's worth.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from ._shared import id_text, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 0
CAPACITY, WINDOW_TOKENS, LINEAR, QUADRATIC = 1024, 1 << 20, 1.0, 1 / 256


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, start in piece, length). There are ceil(total / capacity) of
    them; a piece that none of them has room for is cut to fill the cheapest open one, and its rest
    is placed like any piece."""
    cost = lambda n: linear * n + quadratic * n * n
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(-(-sum(lengths) // capacity))]
    room, costs = np.full(len(out), capacity), np.zeros(len(out))
    todo = [(-cost(n), i, 0, n) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    while todo:
        _, i, start, n = heapq.heappop(todo)
        s = int(np.where(room >= n, costs, np.inf).argmin())
        if room[s] < n:
            s = int(np.where(room > 0, costs, np.inf).argmin())
        take = min(n, int(room[s]))
        if take < n:
            heapq.heappush(todo, (-cost(n - take), i, start + take, n - take))
        out[s].append((i, start, take))
        room[s] -= take
        costs[s] += cost(take)
    return out


def packer(capacity: int, window_tokens: int, linear: float, quadratic: float, tokenizer_path: str, with_ids: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns batches of (doc_id, text) into batches of pieces, a window at a time."""
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.tokenizer(tokenizer_path).ids
        first = TaskContext.get().partitionId() << 32
        pieces: list[tuple[int | None, int, bytes, int]] = []
        held, made = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal pieces, held, made
            cols: list[list] = [[] for _ in range(8)]
            for seq in pack([len(p[2]) >> 2 for p in pieces], capacity, linear, quadratic):
                offset = 0
                for i, start, n in seq:
                    doc_id, at, ids, total = pieces[i]
                    own = ids[4 * start : 4 * (start + n)]
                    for col, v in zip(cols, (doc_id, at + start, n, zlib.crc32(own), total, first + made, offset, own), strict=True):
                        col.append(v)
                    offset += n
                made += 1
            pieces, held = [], 0
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.array([*encode(text.as_py()), END_ID], "<u4").tobytes()
                total = len(raw) >> 2
                for k in range(0, total, capacity):
                    pieces.append((doc_id, k, raw[4 * k : 4 * (k + capacity)], total))
                    held += min(capacity, total - k)
                    if held >= window_tokens:
                        yield flush()
        if pieces:
            yield flush()

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids binary, little-endian unsigned 32-bit, if with_ids).

    A document is its ids, then id 0; a null or empty text is id 0 alone; equal rows are packed each
    for itself, a null doc_id stays null; an empty table gives none. Documents over the capacity are
    cut at its multiples. A sequence_id is the partition in its upper bits and a count in its lower
    32; with the same partitions of input a lost task gives the same rows again.
    """
    run = packer(capacity, window_tokens, linear, quadratic, tokenizer_path or tokens.default_path(), with_ids)
    return id_text(docs).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

"""Suffix-array dedup: bytes covered by a long string that also starts earlier.

A window is `LENGTH` bytes. Its anchor is the K bytes in it with the least hash (the first such), so equal
windows have equal anchors. Consecutive windows with one anchor make up a block of text, some 40
windows long. Three steps find every window that starts earlier too, and no other:

1. Blocks meet by anchor. Of equal blocks all but the first are repeats whole; an anchor that only one
   block has repeats nothing.
2. Where an anchor has different blocks, they may still share windows. A window has K bytes more to the
   left or the right of its anchor, so blocks that share one agree there too; 12 bits of a hash of
   each side tell most others apart. The text of those left goes to buckets by anchor, and the
   blocks' matching statistics are streamed against their bucket's run-length index (rindex.py).
3. An anchor with more than CROWD different blocks, as a line that a third of all documents share, would
   fill one bucket. Its blocks part into windows, which meet by their hashes alone.

A document is known by doc_id and a hash of its text (63 bits; a null doc_id is the largest number and a
key that isn't negative, so it comes after all others). Of rows that agree in both, one is treated as
the document, and the others repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import appended, stored, table
from .rindex import RunLengthIndex

LENGTH, K = 100, 32
CROWD = 8192
#: A block's number of windows has 7 bits; what follows are two marks of MARK_BITS bits.
COUNT_BITS, MARK_BITS = 7, 12
#: Bytes of text that are cut into blocks at once, and that a bucket is planned for.
CHUNK, BUCKET = 1 << 21, 1 << 20
PLACE = np.uint64((1 << 24) - 1)
NULL_ID = (1 << 63) - 1  # sorts last
MARK, TEXT, APART = 1, 2, 3
WHO = "doc long, key long"


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the K bytes from each place, and where the anchor of the window at each place is."""
    h, span = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while span < K:
        a, b = h[:-span], h[span:]
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        span *= 2
    least, span, width = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - K + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return h, (least & PLACE).astype(np.int64)


def blocks(data: bytes, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, content hash, first window, and number of windows with the marks of both sides, of
    each block of data, where stops are the ends of the documents in it."""
    import xxhash

    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, at = anchors(np.frombuffer(data, np.uint8))
    n = np.arange(len(at))
    whose = np.searchsorted(stops, n, "right")
    inside = n + LENGTH <= stops[np.minimum(whose, len(stops) - 1)]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (whose[1:] != whose[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    first, count = first[inside[first]], count[inside[first]]
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)), np.uint64, len(first))
    anchor = at[first]
    side = lambda where, there: np.where(there, np.maximum(h[np.where(there, where, 0)] >> np.uint64(64 - MARK_BITS), 1), 0).astype(np.int64)
    left = side(anchor - K, anchor - K >= first)
    right = side(anchor + K, anchor + 2 * K <= first + count - 1 + LENGTH)
    return h[anchor], content, first, count | left << COUNT_BITS | right << COUNT_BITS + MARK_BITS


def alike(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows (their last column as of blocks()) agree with another of their group on a side.
    Mark 0 stands for no text there, and agrees with none."""
    out = np.zeros(len(rows), bool)
    for shift in (COUNT_BITS, COUNT_BITS + MARK_BITS):
        mark = rows[:, 5] >> shift & (1 << MARK_BITS) - 1
        key = group << MARK_BITS | mark
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        out |= (mark > 0) & (n[at] > 1)
    return out


def chunks(docs: Iterable[tuple[int, int, bytes]]) -> Iterator[tuple[bytes, list[tuple[int, int, int]], np.ndarray]]:
    """Texts joined up to CHUNK bytes: the bytes, (doc, key, place of the first byte) and ends of each
    part. Longer texts go in parts that overlap by a window less a byte."""
    data, who, stops, size = [], [], [], 0
    for doc, key, raw in docs:
        for a in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
            part = raw[a : a + CHUNK + LENGTH - 1]
            if size and size + len(part) > 2 * CHUNK:
                yield b"".join(data), who, np.array(stops)
                data, who, stops, size = [], [], [], 0
            data.append(part)
            who.append((doc, key, a))
            size += len(part)
            stops.append(size)
    if data:
        yield b"".join(data), who, np.array(stops)


def batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names.split())


FOUND = "state doc key at n anchor"
FOUND_SCHEMA = "state int, doc long, key long, at long, n int, anchor long"


def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, content, doc, key, at, n) of blocks. Of equal blocks met together only the first
    goes on as such; the others have content 0 and anchor 0: they are repeats already."""

    def texts() -> Iterator[tuple[int, int, bytes]]:
        for b in batches:
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield doc, key, text.as_py().encode()

    for data, who, stops in chunks(texts()):
        anchor, content, first, count = blocks(data, stops)
        part = np.searchsorted(stops, first, "right")
        begin = np.concatenate([[0], stops[:-1]])
        doc, key, base = (np.array(c, np.int64) for c in zip(*who, strict=True))
        d, k, at = doc[part], key[part], base[part] + first - begin[part]
        order = np.lexsort((at, k, d, content))
        anchor, content, d, k, at, count = anchor[order], content[order], d[order], k[order], at[order], count[order]
        if not len(content):
            continue
        again = np.concatenate([[False], content[1:] == content[:-1]])
        place = np.concatenate([[False], (d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (at[1:] == at[:-1])]) & again
        anchor[again], content[again] = 0, 0
        anchor, content, d, k, at, count = (x[~place] for x in (anchor, content, d, k, at, count))
        yield batch("anchor content doc key at n", anchor.view(np.int64), content.view(np.int64), d, k, at, count.astype(np.int32))


def firsts(crowd: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by (anchor, content, doc, key, at): MARK rows for repeats of a content, and the
    first row of each content of an anchor that has several, as TEXT up to `crowd` of them, as APART
    beyond. At most the rows of one anchor's first `crowd` contents are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # first rows of the contents of the anchor that isn't over
        n_held, apart = 0, False
        last: tuple | None = None

        def over() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, apart
            rows = np.concatenate(held) if held else np.zeros((0, 6), np.int64)
            if not apart:
                rows = rows[alike(rows, np.zeros(len(rows), np.int64))]
            if len(rows):
                yield said(np.full(len(rows), APART if apart else TEXT), rows)
            held, n_held, apart = [], 0, False

        def said(state: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            return batch(FOUND, state.astype(np.int32), r[:, 2], r[:, 3], r[:, 4], (r[:, 5] & (1 << COUNT_BITS) - 1).astype(np.int32), r[:, 0])

        for b in batches:
            if not b.num_rows:
                continue
            r = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1)
            gone = (r[:, 0] == 0) & (r[:, 1] == 0)
            if gone.any():
                yield said(np.full(int(gone.sum()), MARK), r[gone])
                r = r[~gone]
                if not len(r):
                    continue
            before = np.concatenate([r[:1] if last is None else np.array([last]), r[:-1]])
            same = (r[:, :2] == before[:, :2]).all(1)
            place = (r[:, 2:5] == before[:, 2:5]).all(1)
            if last is None:
                same[0] = place[0] = False
            last = tuple(r[-1].tolist())
            marks = same & ~place  # the same place twice comes from rows that agree in doc_id and text
            if marks.any():
                yield said(np.full(int(marks.sum()), MARK), r[marks])
            heads = r[~same]
            if not len(heads):
                continue
            new = np.concatenate([[not held or bool(held[-1][-1, 0] != heads[0, 0])], heads[1:, 0] != heads[:-1, 0]])
            edges = [0, *np.flatnonzero(new).tolist(), len(heads)]
            # Anchors that begin and end in this batch are done at once; the first and last part may go on.
            first, final = heads[: edges[1]] if len(edges) > 2 else heads, edges[-2]
            if len(edges) > 2:
                held, n_held = [*held, first] if len(first) else held, n_held + len(first)
                if n_held:
                    apart |= n_held > crowd
                    yield from over()
                mid = heads[edges[1] : final] if edges[1] < final else heads[:0]
                if len(mid):
                    starts = np.flatnonzero(np.concatenate([[True], mid[1:, 0] != mid[:-1, 0]]))
                    n = np.repeat(m := np.diff(np.concatenate([starts, [len(mid)]])), m)
                    keep = (n > crowd) | alike(mid, np.repeat(np.arange(len(m)), m))
                    if keep.any():
                        yield said(np.where(n[keep] > crowd, APART, TEXT), mid[keep])
                tail = heads[final:]
            else:
                tail = first
            held.append(tail)
            n_held += len(tail)
            if n_held > crowd:
                apart = True
                rows = np.concatenate(held)
                yield said(np.full(len(rows) - 1, APART), rows[:-1])
                held, n_held = [rows[-1:]], 1
        if held:
            yield from over()

    return run


def stretch(r: dict) -> list[tuple[bytes, dict]]:
    """The text of each block that is asked for of a document."""
    raw = r["text"].encode()
    return [(raw[a["at"] : a["at"] + a["n"] + LENGTH - 1], a) for a in r["asked"]]


def asked_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, dict]]:
    for b in batches:
        for doc, key, text, asked in zip(*b.columns, strict=True):
            for raw, a in stretch({"text": text.as_py(), "asked": asked.as_py()}):
                yield doc.as_py(), key.as_py(), raw, a


def snippets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(a["anchor"], doc, key, a["at"], a["n"], raw) for doc, key, raw, a in asked_rows([b])]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "doc", "key", "at", "n", "raw"])


def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows like cut()'s, a block being one window and anchor and content its hash."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest
    for b in batches:
        rows = []
        for doc, key, raw, a in asked_rows([b]):
            for i in range(a["n"]):
                h = digest(raw[i : i + LENGTH])
                rows.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc, key, a["at"] + i, 1))  # no marks: only repeats count
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield batch("anchor content doc key at n", *(np.array(c, np.int32 if i == 5 else np.int64) for i, c in enumerate(cols)))


def bucket_repeats(t: pa.Table) -> pa.Table:
    """Repeats among a bucket's blocks, as runs of windows."""
    order = t.sort_by([("doc", "ascending"), ("key", "ascending"), ("at", "ascending")])
    place = np.stack([order[c].to_numpy().astype(np.int64) for c in ("doc", "key", "at")], 1)
    order = order.filter(pa.array(np.concatenate([[True], (place[1:] != place[:-1]).any(1)])))  # rows that agree in doc_id and text send the same
    raw = order["raw"].to_pylist()
    n = order["n"].to_numpy().astype(np.int64)
    flags = RunLengthIndex(raw, LENGTH).repeats(raw)
    flags &= np.arange(flags.shape[1])[None] < n[:, None]
    wide = np.zeros((len(raw), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    edge = np.diff(wide, axis=1)
    (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    at = order["at"].to_numpy()[row] + a
    return pa.table({"doc": order["doc"].to_numpy()[row], "key": order["key"].to_numpy()[row], "at": at, "n": (b - a).astype(np.int32)})


def repeats(docs: DataFrame, crowd: int = CROWD, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text, and _runs (starts and ends of maximal runs of repeated bytes, in turn) for each
    row of docs.

    A null or empty text has no bytes, one under LENGTH no repeats; a null doc_id comes after all
    others; rows that agree in doc_id and text: the first has its own repeats, the others are repeats
    whole if LENGTH bytes or longer; an empty table gives none.
    """
    half = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1)
    key = F.when(F.col("doc_id").cast("long").isNull(), half).otherwise(-half - 1)
    sides = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block = f"anchor long, content long, {WHO}, at long, n int"
    by = ["anchor", "content", "doc", "key", "at"]
    meet = lambda df, key, k: df.repartition(key).sortWithinPartitions(*by).mapInArrow(firsts(k), FOUND_SCHEMA)
    # Blocks that are repeats already are spread by where they are.
    spread = F.when((F.col("anchor") == 0) & (F.col("content") == 0), F.xxhash64("doc", "at")).otherwise(F.col("anchor"))
    found = stored(meet(sides.filter(F.octet_length("text") >= LENGTH).mapInArrow(cut, block), spread, crowd), "blocks")
    states = {r.state: (r.rows, r.bytes) for r in found.groupBy("state").agg(F.count("*").alias("rows"), F.sum(F.col("n") + LENGTH - 1).alias("bytes")).collect()}
    marks = found.filter(F.col("state") == MARK).select("doc", "key", "at", "n")

    def asking(state: int) -> DataFrame:
        asked = found.filter(F.col("state") == state).groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "at", "n")).alias("asked"))
        return sides.join(asked, ["doc", "key"]).select("doc", "key", "text", "asked")

    if TEXT in states:
        n = max(1, -(-states[TEXT][1] // bucket))
        text = asking(TEXT).mapInArrow(snippets, f"anchor long, {WHO}, at long, n int, raw binary")
        marks = marks.unionByName(text.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n)).alias("bucket")).applyInArrow(bucket_repeats, f"{WHO}, at long, n int"))
    if APART in states:
        each = asking(APART).mapInArrow(windows, block)
        marks = marks.unionByName(meet(each, "content", 1 << 62).filter(F.col("state") == MARK).select("doc", "key", "at", "n"))
    marks = marks.groupBy("doc", "key").agg(F.collect_list(F.struct("at", "n")).alias("marks"))

    def joined() -> Callable[[list], list[list]]:
        def make(rows: list) -> list[list]:
            out = []
            for m in rows:
                runs: list[int] = []
                if m:
                    at = np.array([(x["at"], x["at"] + x["n"] + LENGTH - 1) for x in m], np.int64)
                    at = at[np.argsort(at[:, 0], kind="stable")]
                    end = np.maximum.accumulate(at[:, 1])
                    new = np.flatnonzero(np.concatenate([[True], at[1:, 0] > end[:-1]]))
                    runs = np.stack([at[new, 0], end[np.concatenate([new[1:] - 1, [len(at) - 1]])]], 1).ravel().tolist()
                out.append(runs)
            return [out]

        return make

    out = appended(sides.join(marks, ["doc", "key"], "left"), "marks", "_runs array<long>", joined).drop("marks")
    # Rows that agree in doc_id and text lie together; their number is their rank but for ties, which are alike.
    again = F.row_number().over(_same_rows()) > 1
    whole = F.array(F.lit(0).cast("long"), F.octet_length("text").cast("long"))
    out = out.withColumn("_runs", F.when(again & (F.octet_length("text") >= LENGTH), whole).otherwise(F.col("_runs")))
    return out.select(F.when((F.col("doc") == NULL_ID) & (F.col("key") >= 0), F.lit(None)).otherwise(F.col("doc")).alias("doc_id"), "text", "_runs")


def _same_rows():
    from pyspark.sql import Window

    return Window.partitionBy("doc", "key").orderBy(F.lit(0))


def kept(text: str, runs: list[int]) -> bytes:
    raw, out, at = text.encode(), [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start() -> Callable[[list], list[list]]:
        def make(rows: list) -> list[list]:
            left = [kept(r["text"], r["runs"]) for r in rows]
            return [[len(r["text"].encode()) for r in rows], list(map(len, left)), [hashlib.sha256(x).hexdigest() for x in left]]

        return make

    found = repeats(table(spark, sf_dir, "documents")).select("doc_id", F.struct("text", F.col("_runs").alias("runs")).alias("_both"), (F.size("_runs") / 2).cast("long").alias("n_spans"))
    out = appended(found, "_both", "n_bytes long, _left long, kept_sha256 string", start)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.col("_left")).alias("n_removed"), "n_spans", "kept_sha256")

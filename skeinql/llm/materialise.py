"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents are packed into sequences of `length` ids, which are stored once; a sequence's index is its
partition's first index and its place there. With n sequences in all, a keyed Feistel permutation of the
least even number of bits that holds n, walked along its cycle until it is below n, gives the index its
global slot, and gives it back. Shard k holds the slots from k * stride on, `stride` of them but in the
last, each of `length` ids of 2 or 4 bytes (little-endian), padded with `pad`: any slot's place follows
from its number, so a reader can start anywhere and read on. Sequences go to tasks by ranges of shards,
those of a batch and shard together and compressed. Names and bytes of shards depend on nothing but
the rows, so a task that runs again writes the same file.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from ._shared import id_text, new_path, stored, table
from .packing import LINEAR, QUADRATIC, WINDOW_TOKENS, packer

LENGTH, STRIDE, PAD, KEY = 1024, 4096, 50256, 20240229
ROUNDS = 4
#: Most tasks that write shards; with more shards than that a task writes several, one after the other.
TASKS = 4096


def round_keys(key: int) -> np.ndarray:
    return np.random.default_rng(key).integers(0, 1 << 64, ROUNDS, np.uint64, endpoint=False)


def feistel(x: np.ndarray, bits: int, key: int, back: bool = False) -> np.ndarray:
    """A permutation of [0, 2^bits), bits even; back: its inverse."""
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << bits // 2) - 1)
    left, right = x >> half, x & mask
    keys = round_keys(key)
    mixed = lambda v, k: (((v + k) * np.uint64(0x9E3779B97F4A7C15) ^ (v * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)) & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ mixed(left, k), left
        else:
            left, right = right, left ^ mixed(right, k)
    return left << half | right


def slots(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each index in [0, n); back: the index of each slot."""
    bits = max(2, int(n - 1).bit_length() + int(n - 1).bit_length() % 2)
    out = feistel(index.astype(np.uint64), bits, key, back)
    while (over := out >= n).any():
        out[over] = feistel(out[over], bits, key, back)
    return out.astype(np.int64)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


PIECES = "doc_id array<long>, start array<long>, length array<long>"


def by_sequence(kind: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each sequence, of the packer's batches: windows, so a sequence's pieces are in one."""
    names = ("sequence_id", "doc_id", "start", "length", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            seq = t["sequence_id"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            parts = [[c[x:y] for x, y in zip(first, [*first[1:], len(seq)], strict=True)] for c in (t[n].to_pylist() for n in names[1:])]
            ids = [np.frombuffer(b"".join(p), "<u4").astype(kind).tobytes() for p in parts[3]]
            yield pa.RecordBatch.from_arrays([pa.array(seq[first]), *(pa.array(p, pa.list_(pa.int64())) for p in parts[:3]), pa.array(ids, pa.binary())], [*names])

    return run


def router(firsts: dict[int, int], n: int, stride: int, key: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of sequences: for each shard that a batch has some of, their places in it, how many
    pieces each has, the pieces' columns, and all their ids, compressed."""
    names = ["shard", "place", "pieces", "doc_id", "start", "length", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=7).compress
        for t in batches:
            seq = t["sequence_id"].to_numpy()
            if not len(seq):
                continue
            part, at = np.unique(seq >> 32, return_inverse=True)
            slot = slots(np.array([firsts[p] for p in part.tolist()])[at] + (seq & (1 << 32) - 1), n, key)
            order = np.argsort(slot)
            t, slot = t.take(pa.array(order)), slot[order]
            shard = slot // stride
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True))
            held = {c: t[c].to_pylist() for c in names[3:]}
            flat = [[[x for own in held[c][a:b] for x in own] for a, b in cuts] for c in names[3:6]]
            cols = [shard[first].tolist(), [(slot[a:b] % stride).tolist() for a, b in cuts], [list(map(len, held["length"][a:b])) for a, b in cuts], *flat, [pack(b"".join(held["ids"][a:b])) for a, b in cuts]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def writer(path: str, n: int, stride: int, length: int, kind: str, pad: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the router's rows sorted by shard: writes each shard and returns a row for each of its slots.
    One shard at a time is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path)
        task = TaskContext.get().taskAttemptId()
        system.create_dir(folder)
        unpack = zstandard.ZstdDecompressor().decompress

        def write(shard: int, rows: list[dict]) -> pa.RecordBatch:
            out = np.full((min(stride, n - shard * stride), length), pad, kind)
            made = []
            for r in rows:
                ids, at, piece = np.frombuffer(unpack(r["ids"]), kind), 0, 0
                for place, k in zip(r["place"], r["pieces"], strict=True):
                    own = r["length"][piece : piece + k]
                    begin, crc = at, []
                    for m in own:
                        crc.append(zlib.crc32(ids[at : at + m].astype("<u4").tobytes()))
                        at += m
                    out[place, : at - begin] = ids[begin:at]
                    made.append((shard, place, r["doc_id"][piece : piece + k], r["start"][piece : piece + k], own, crc))
                    piece += k
            name = f"{folder}/.{shard_name(shard)}.{task}"
            with system.open_output_stream(name) as f:
                f.write(out.tobytes())
            system.move(name, f"{folder}/{shard_name(shard)}")
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], ["shard", "place", "doc_id", "start", "length", "crc"])

        shard, held = -1, []
        for b in batches:
            for row in b.to_pylist():
                if row["shard"] != shard and held:
                    yield write(shard, held)
                    held = []
                shard = row["shard"]
                held.append(row)
        if held:
            yield write(shard, held)

    return run


def materialise(docs: DataFrame, path: str, length: int = LENGTH, stride: int = STRIDE, key: int = KEY, pad: int = PAD, tokenizer_path: str | None = None, tasks: int = TASKS) -> DataFrame:
    """Write the shards under path (any file system that pyarrow opens by URI), and path/manifest (a row
    of sequences, stride, length, width, key: Parquet); return a row for each piece of a document:
    doc_id, start, length, ids_crc32, slot, shard, byte_offset.

    A null or empty text is id 0 alone; a null doc_id stays null; equal rows are written each for itself;
    an empty table writes no shard; columns of other names play no part. Ids take 2 bytes where the
    vocabulary allows.
    """
    spark, tokenizer_path = docs.sparkSession, tokenizer_path or tokens.default_path()
    wide = tokens.tokenizer(tokenizer_path).size > 1 << 16 or pad >= 1 << 16
    kind, width = ("<u4", 4) if wide else ("<u2", 2)
    pack, gather = packer(length, WINDOW_TOKENS, LINEAR, QUADRATIC, tokenizer_path, True), by_sequence(kind)
    sequences = stored(id_text(docs).mapInArrow(lambda batches: gather(pack(batches)), f"sequence_id long, {PIECES}, ids binary"), "sequences", **{"parquet.page.size": str(1 << 18)})
    firsts, n = {}, 0
    # A number for each partition of the input.
    for r in sorted(sequences.groupBy(F.shiftright("sequence_id", 32).alias("part")).agg(F.count("*").alias("n")).collect()):
        firsts[r.part] = n
        n += r.n
    shards = -(-n // stride)
    parts = max(1, min(shards, tasks))
    sent = sequences.mapInArrow(router(firsts, n, stride, key), f"shard long, place array<long>, pieces array<long>, {PIECES}, ids binary")
    ordered = sent.repartitionById(parts, F.floor(F.col("shard") * parts / F.lit(max(1, shards))).cast("int")).sortWithinPartitions("shard")
    written = stored(ordered.mapInArrow(writer(path, n, stride, length, kind, pad), f"shard long, place long, {PIECES}, crc array<long>"), "written")
    spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in (("sequences", n), ("stride", stride), ("length", length), ("width", width), ("key", key)))).write.mode("overwrite").parquet(f"{path}/manifest")
    piece = F.explode(F.arrays_zip("doc_id", "start", "length", "crc", F.transform("length", lambda _, i: F.aggregate(F.slice("length", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)).alias("before"))).alias("x")
    at = ((F.col("place") * length + F.col("x.before")) * width).cast("long")
    return written.select("shard", "place", piece).select("x.doc_id", "x.start", "x.length", F.col("x.crc").alias("ids_crc32"), (F.col("shard") * stride + F.col("place")).alias("slot"), "shard", at.alias("byte_offset"))


def read_slots(path: str, first: int, n: int) -> np.ndarray:
    """n sequences from slot `first` on, or fewer at the end; reads only their bytes."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path)
    m = pq.read_table(f"{folder}/manifest", filesystem=system).to_pylist()[0]
    stride, length, width = m["stride"], m["length"], m["width"]
    out, last = [np.zeros((0, length), f"<u{width}")], min(first + n, m["sequences"])
    while first < last:
        shard, place = divmod(first, stride)
        count = min(last - first, stride - place)
        with system.open_input_file(f"{folder}/{shard_name(shard)}") as f:
            f.seek(place * length * width)
            out.append(np.frombuffer(f.read(count * length * width), f"<u{width}").reshape(-1, length))
        first += count
    return np.concatenate(out)


def op5_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(id_text(table(spark, sf_dir, "documents")), new_path(spark, "training"))

"""Near copies: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Candidates come from SimHash fingerprints of the sets through vantage points. At similarity s a bit
differs with probability acos(2s / (1 + s)) / pi, 0.15 at 0.8, too often for one search of 64 bits. So
a fingerprint is long, and each of several tables searches some of its bits: PREFIX of them part the
table, and WIDTH others are searched within RADIUS by operator 3's shells around vantage points, by
the triangle inequality and parity. Fingerprints that meet there are candidates if they are close on
the bits that go along. Those of a table are found with probability P, and there are as many tables as
(1 - P)^tables < MISSED asks for. All different sets that candidates connect are then compared
exactly, and give a spanning forest of their links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import appended, id_text, stored
from .components import components
from .simhash import dealt, hashes, joined, leaves, one_each

WORDS, SIMILARITY = 5, 0.8
SEED = 42
#: Blocks of 64 bits of a fingerprint, and those that go along to where it is compared.
BLOCKS, ALONG = 16, 3
#: Bits that are searched in a table, the vantage points (their distances to random bits are
#: uncorrelated), and by how many bits others may differ.
WIDTH, POINTS, RADIUS = 8, np.array([0x00, 0x0F, 0x33], np.uint64), 1
#: Chance that all tables miss a pair of the least similarity; standard deviations by which a link's
#: bits may differ more than they are expected to.
MISSED, MARGIN = 1e-5, 5.5
#: Expected fingerprints of a prefix, half of the most in a task; pairs that are compared together.
MEETING, CELLS = 8000, 1 << 18
#: Most sets of a part of a group, and their bytes.
PART, PART_BYTES = 500, 1 << 22
#: Rows whose sets are made, or fingerprints dealt, before they are passed on.
SLICE = 256


@functools.cache
def keys() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, BLOCKS, np.uint64, endpoint=False)


def digest(values: np.ndarray) -> int:
    import xxhash

    return (xxhash.xxh64_intdigest(values.tobytes(), SEED) + (1 << 63)) % (1 << 64) - (1 << 63)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text's shingle hashes, in order."""
    return np.unique(hashes(text, words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A row for each hash: other 64 bits for each block (the finalizer of SplitMix64)."""
    z = h[:, None] ^ keys()
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def blocks(s: np.ndarray) -> list[int]:
    """A set's SimHash fingerprint, in signed blocks of 64 bits: those set in over half of its hashes;
    none for an empty set."""
    if not len(s):
        return []
    count = np.zeros(64 * BLOCKS, np.int64)
    for k in range(0, len(s), 255):
        count += np.unpackbits(mixed(s[k : k + 255]).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * count > len(s)).view(np.int64).tolist()


def differs(least: float) -> float:
    """The chance that a bit differs between sets of that similarity."""
    return math.acos(2 * least / (1 + least)) / math.pi


def tables(n: int, least: float) -> tuple[int, int]:
    """Bits of a prefix, and how many tables n texts need."""
    p, prefix = differs(least), max(0, math.ceil(math.log2(max(n, 1) / MEETING)))
    found = (1 - p) ** prefix * sum(math.comb(WIDTH, k) * p**k * (1 - p) ** (WIDTH - k) for k in range(RADIUS + 1))
    return prefix, math.ceil(math.log(MISSED) / math.log1p(-found)) if found < 1 else 1


def close(bits: int, least: float) -> int:
    """By how many of so many bits candidates may differ."""
    p = differs(least)
    return math.floor(p * bits + MARGIN * math.sqrt(p * (1 - p) * bits))


def places(bits: int, width: int, count: int) -> np.ndarray:
    """For each table the places of its bits in a fingerprint; a place is taken again once all are."""
    rng, each = np.random.default_rng(SEED), bits // width
    return np.concatenate([rng.permutation(bits)[: each * width].reshape(each, width) for _ in range(-(-count // each))])[:count]


def met(prints: np.ndarray, spots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """prints: a row of blocks for each fingerprint, spots: the bits that are searched. Candidates that
    meet around the vantage points, as a forest of their places."""
    at, rows = leaves(spots, POINTS, RADIUS)
    home = np.zeros(at.shape, bool)
    home[0] = True
    at, rows, home = at.ravel(), rows.ravel(), home.ravel()
    order = np.lexsort((~home, at))
    some, root = min(2, prints.shape[1]), np.arange(len(prints))
    first, whole, column = close(64 * some, least), close(64 * prints.shape[1], least), [np.ascontiguousarray(c) for c in prints.T]
    for leaf in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        own, visit = rows[leaf[home[leaf]]], rows[leaf]
        step = max(1, CELLS // max(1, len(own)))
        for k in range(0, len(visit) if len(own) else 0, step):
            d = np.bitwise_count(column[0][visit[k : k + step], None] ^ column[0][own])
            for c in column[1:some]:
                d += np.bitwise_count(c[visit[k : k + step], None] ^ c[own])
            i, j = np.divmod(np.flatnonzero(d <= first), len(own))
            i, j = visit[k + i], own[j]
            near = np.bitwise_count(prints[i] ^ prints[j]).sum(1) <= whole
            root = joined(root, i[near], j[near])
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def candidates(prints: DataFrame, n: int, least: float = SIMILARITY) -> DataFrame:
    """prints: (_node, _blocks) of about n different sets, none empty. Rows (u, v) that connect the
    nodes of sets that may be similar.

    A prefix that over 2 * MEETING fingerprints share is dealt into parts of that size, and each pair of
    parts is searched in a task of its own.
    """
    prefix, count = tables(n, least)
    along = [f"_b{k}" for k in range(ALONG)]

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                b = batch.slice(k, SLICE)
                own = b.column(1).flatten().to_numpy().reshape(len(b), -1)
                bits = np.unpackbits(own.view(np.uint8), axis=1)
                taken = bits[:, places(bits.shape[1], WIDTH + prefix, count)] @ (1 << np.arange(WIDTH + prefix))
                leaf, spot = (np.arange(count) << prefix) + (taken >> WIDTH), taken & ((1 << WIDTH) - 1)
                more = [own[:, min(c, own.shape[1] - 1)].repeat(count) for c in range(ALONG)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (leaf.ravel(), b.column(0).to_numpy().repeat(count), spot.ravel(), *more)], ["leaf", "fp", "_spot", *along])

    def compare(t: pa.Table) -> pa.Table:
        u, v = met(np.stack([t[c].to_numpy() for c in along], 1).view(np.uint64), t["_spot"].to_numpy().view(np.uint64), least)
        node = t["fp"].to_numpy()
        return pa.table({"u": node[u], "v": node[v]})

    routed = prints.select("_node", "_blocks").mapInArrow(route, "leaf long, fp long, _spot long, " + ", ".join(f"{c} long" for c in along))
    return dealt(routed.withColumn("home", F.lit(True)), MEETING, "_spot", *along).groupBy("leaf", "low", "high").applyInArrow(compare, "u long, v long")


def forest(own: list[np.ndarray], others: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of others with own, as a forest; places count own first. Sets aren't empty."""
    sets = own + others
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    first, n = (ends - sizes)[: len(own)], ends[len(own) - 1]
    has, label, out = np.zeros(ids.max() + 1, np.int64), np.arange(len(sets)), []
    for x in range(len(own), len(sets)):
        mine = ids[ends[x] - sizes[x] : ends[x]]
        has[mine] = 1
        both = np.add.reduceat(has[ids[:n]], first)
        has[mine] = 0
        for j in np.flatnonzero(both >= least * (sizes[x] + sizes[: len(own)] - both)):
            if label[j] != label[x]:
                label[label == label[j]] = label[x]
                out.append((x, int(j)))
    return out


def compared(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """members: (block, _node). Rows (u, v) that connect what similar members of a block connect.

    Blocks of the same members are compared once. A block of over PART sets or PART_BYTES is dealt into
    parts of that size, and each pair of parts is compared in a task of its own.
    """

    def compare(t: pa.Table) -> pa.Table:
        node, part = t["_node"].to_numpy(), t["part"].to_numpy()
        values = [np.frombuffer(x, np.uint64) for x in t["_set"].to_pylist()]
        own, others = np.flatnonzero(part == t["low"][0].as_py()), np.flatnonzero(part == t["high"][0].as_py())
        if not len(own) or not len(others):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        at = np.concatenate([own, others])
        found = forest([values[k] for k in own], [values[k] for k in others], least)
        return pa.table({c: pa.array([int(node[at[x[k]]]) for x in found], pa.int64()) for k, c in enumerate("uv")})

    size = F.octet_length("_set")
    known = members.join(sets.select("_node", size.alias("bytes")), "_node")
    made = known.groupBy("block").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("_node")).alias("x"), F.bit_xor(F.xxhash64("_node", F.lit(1))).alias("y"))
    made = made.groupBy("n", "bytes", "x", "y").agg(F.min("block").alias("block"))
    parts = stored(made.select("block", F.greatest(F.lit(1), F.ceil(F.col("n") / PART), F.ceil(F.col("bytes") / PART_BYTES)).cast("int").alias("parts")), "parts")
    tasks = members.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("_node"), "parts").cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.select("block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "_node", "part")
    return tasks.join(sets, "_node").groupBy("block", "low", "high").applyInArrow(compare, "u long, v long")


def similar_groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) for each row of docs.

    Texts of the same shingles link, those without words too; a text shorter than a shingle is one.
    A null doc_id is never a component_id unless a component has no other; an empty table gives none.
    """

    def start() -> Callable[[list], list[list]]:
        def one(text: str | None) -> tuple[int, list[int]]:
            s = shingles(text, words)
            return digest(s), blocks(s)

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] or [[], []]

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                b = batch.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], ["_node", "_set"])

    # One row stands for all that share a text; its doc_id keeps it apart from the others' texts.
    slim = id_text(docs).withColumn("_key", F.xxhash64("text")).withColumn("_at", F.coalesce("doc_id", F.lit(0)))
    prints = stored(appended(slim, "text", "_node long, _blocks array<long>", start).drop("text"), "prints")
    first = stored(prints.groupBy("_node").agg(F.min("doc_id").alias("least"), F.min(F.struct("_key", "_at")).alias("_row"), F.first("_blocks").alias("_blocks")), "different")
    found = stored(components(candidates(first.filter(F.size("_blocks") > 0), first.count(), least)), "candidates")
    members = stored(found.select(F.col("label").alias("block"), F.col("node").alias("_node")).union(found.select("label", "label").distinct()), "members")
    wanted = members.select("_node").join(first.select("_node", "_row._key", "_row._at"), "_node")
    texts = stored(slim.select("_key", "_at", "text").join(wanted, ["_key", "_at"]).dropDuplicates(["_key", "_at"]).select("_node", "text"), "texts")
    sets = stored(texts.mapInArrow(sets_of, "_node long, _set binary"), "sets")
    star = stored(components(compared(members, sets, least)), "star")
    labelled = stored(first.join(star, F.col("_node") == F.col("node"), "left").select("_node", "least", F.coalesce("label", "_node").alias("label")), "labelled")
    smallest = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    return prints.join(labelled.join(smallest, "label").select("_node", "component_id"), "_node").select("doc_id", "component_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each group (its component_id) stays, with the columns of docs. Of repeated
    rows one stays; rows without a doc_id, which no other row can stand for, all stay."""
    return one_each(docs, similar_groups(docs))

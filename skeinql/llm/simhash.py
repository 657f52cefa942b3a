"""SimHash near-dedup: fingerprints linked at a small Hamming distance through a vantage-point tree.

Each level of the tree has a vantage point and splits its fingerprints into shells by their distance
to it, one shell for each distance. By the triangle inequality two fingerprints at distance t lie in
shells at most t apart on every level, and as each differing bit moves every distance by one, the
moves of one level have t's parity. So a fingerprint has to visit only the few leaves that those
bounds leave, and of two neighbouring leaves only one is visited by the other's fingerprints. Leaves
are compared whole, in numpy, and give a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import appended, id_text, stored, table
from .components import components

RADIUS = 2
WORDS = 3
SEED = 42
#: Expected fingerprints of a leaf; with more, the tree gets another level.
LEAF = 2000
#: Chance that two random 64-bit fingerprints lie in the same shell: sum of squares of C(64, k) / 2^64.
SAME_SHELL = 0.0704
BASE = 1 << 7
CELLS = 1 << 22


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    w = text.encode().lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        shingles: Iterable = [tuple(w)] if w else []
    else:
        shingles = zip(*(itertools.islice(w, k, None) for k in range(words)), strict=False)
    return np.array([digest(s, SEED) for s in map(b" ".join, shingles)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """As an unsigned number: bits set in over half the hashes."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 18):
        count += np.unpackbits(h[k : k + (1 << 18)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with _fp, the fingerprint as a signed long. A null or empty text, or one of white space,
    has fingerprint zero."""

    def start() -> Callable[[list], list[list]]:
        return lambda texts: [np.array([fingerprint(hashes(t)) for t in texts], np.uint64).view(np.int64).tolist()]

    return appended(docs, "text", "_fp long", start)


def levels(n: int, leaf: int = LEAF) -> int:
    return max(1, int(np.ceil(np.log(max(n, 1) / leaf) / -np.log(SAME_SHELL))))


def vantage_points(depth: int) -> np.ndarray:
    """Pseudo-random, the same in every run; they needn't be fingerprints of documents."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, depth, np.uint64, endpoint=False)


def moves(depth: int, radius: int) -> np.ndarray:
    """By how many shells on each level another fingerprint within the radius can be away: its own
    leaf first, then one of each two opposite moves."""
    out = {v for t in range(radius + 1) for v in itertools.product(range(-t, t + 1, 2), repeat=depth)}
    return np.array([(0,) * depth, *sorted(v for v in out if v > (0,) * depth)])


def leaves(fps: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, fingerprint's index) for each leaf that a fingerprint belongs to, then for each it visits."""
    at = np.bitwise_count(fps[:, None] ^ points[None]).astype(np.int64)
    weights = BASE ** np.arange(len(points), dtype=np.int64)
    off = moves(len(points), radius)
    # Shells below 0 or over 64 don't exist; a visitor there meets nobody.
    keys = ((at[None] + off[:, None] + radius) * weights).sum(2)
    return keys, np.broadcast_to(np.arange(len(fps)), keys.shape)


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, where every place names the least of its tree, after i and j of each link are in one tree."""
    while True:
        a, b = root[i], root[j]
        if not (apart := a != b).any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def forest(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a leaf's fingerprints with each other and with its visitors, as a forest."""
    nodes = np.concatenate([own, visitors])
    root = np.arange(len(nodes))
    rows = max(1, CELLS // max(1, len(own)))
    for k in range(0, len(nodes), rows):
        i, j = np.nonzero(np.bitwise_count(nodes[k : k + rows, None] ^ own[None]) <= radius)
        root = joined(root, i + k, j)
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def dealt(routed: DataFrame, leaf: int, *more: str) -> DataFrame:
    """routed: (leaf, fp, home) and more. Rows (leaf, low, high, fp, home) and more, one for each task
    (leaf, low, high) that a fingerprint takes part in; home marks those that all others of the task
    are compared with.

    A leaf with more than 2 * leaf fingerprints of its own, or 8 * leaf visitors, is dealt into parts of
    that size, visitors numbered on: pairs of own parts, and each own part with each part of visitors,
    are tasks.
    """
    sizes = routed.groupBy("leaf").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("others"))
    crowded = sizes.filter((F.col("own") > 2 * leaf) | (F.col("own") > 0) & (F.col("others") > 8 * leaf))
    parts = stored(crowded.select("leaf", F.ceil(F.col("own") / (2 * leaf)).cast("int").alias("parts"), F.ceil(F.col("others") / (8 * leaf)).cast("int").alias("guests")), "crowded")
    home, last = F.col("home"), F.col("parts") - 1
    one_of = lambda n: F.pmod(F.xxhash64("fp"), F.greatest(n, F.lit(1))).cast("int")
    at = F.when(home, one_of(F.col("parts"))).otherwise(F.col("parts") + one_of(F.col("guests")))
    met = F.sequence(F.lit(0), F.when(home, last + F.col("guests")).otherwise(last))
    known = F.col("parts").isNotNull()
    rows = routed.join(parts, "leaf", "left").withColumn("at", F.when(known, at).otherwise(0)).withColumn("other", F.explode(F.when(known, met).otherwise(F.array(F.lit(0)))))
    low = F.least("at", "other")
    return rows.select("leaf", low.alias("low"), F.greatest("at", "other").alias("high"), "fp", (home & (F.col("at") == low)).alias("home"), *more)


def links(fps: DataFrame, n: int, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """fps: different fingerprints (_fp), n of them. Rows (u, v) of longs that connect exactly what
    links within the radius connect.

    No vantage point parts a crowd of near copies, whose distances to all of them agree; its leaf is
    compared in parts, a task for each pair of them, whether they are its own or visit.
    """
    points = vantage_points(levels(n, leaf))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(x), 4096):
                part = x[k : k + 4096]
                keys, at = leaves(part, points, radius)
                home = np.zeros(keys.shape, bool)
                home[0] = True
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(part[at.ravel()].view(np.int64)), pa.array(home.ravel())], ["leaf", "fp", "home"])

    def compare(t: pa.Table) -> pa.Table:
        fp, home = t["fp"].to_numpy().view(np.uint64), t["home"].to_numpy()
        u, v = forest(fp[home], fp[~home], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    routed = fps.select("_fp").mapInArrow(route, "leaf long, fp long, home boolean")
    return dealt(routed, leaf).groupBy("leaf", "low", "high").applyInArrow(compare, "u long, v long")


def groups(docs: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """doc_id, _fp and component_id (the smallest doc_id that links reach) for each row of docs.

    Rows without words have fingerprint zero and link like any other; equal rows link. A null doc_id
    is never a component_id unless a component has no other; an empty table gives none.
    """
    prints = stored(fingerprints(id_text(docs)).select("doc_id", "_fp"), "prints")
    first = stored(prints.groupBy("_fp").agg(F.min("doc_id").alias("least")), "different")
    star = components(links(first, first.count(), radius, leaf))
    labelled = stored(first.join(star, F.col("_fp") == F.col("node"), "left").select("_fp", "least", F.coalesce("label", "_fp").alias("label")), "labelled")
    least = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    own = stored(labelled.join(least, "label").select("_fp", "component_id"), "own")
    return prints.join(own, "_fp")


def one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stand for their groups: those whose doc_id is the component_id in found,
    which has a row for each of docs. Only rows that share a doc_id are moved to drop all but one. Both
    sides of the join grow with the corpus, so neither is sent to all."""
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("own"))
    stay = stored(ids.filter("own").select("doc_id", "n"), "stay")
    of = lambda rows: docs.filter("doc_id is not null").join(stay.filter(rows).select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    out = of("n = 1").unionByName(docs.filter("doc_id is null"))
    return out if stay.filter("n > 1").isEmpty() else out.unionByName(of("n > 1").dropDuplicates(["doc_id"]))


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group (its component_id) stays, with the columns of docs. Of repeated
    rows one stays; rows without a doc_id, which no other row can stand for, all stay."""
    return one_each(docs, groups(docs, radius))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")

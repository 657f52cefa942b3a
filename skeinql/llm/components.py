"""Connected components of an edge table by alternating stars (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 32)))).first())


def _star(both: DataFrame, large: bool) -> DataFrame:
    """both: rows (u, v), u's neighbours v. Large: links u's larger neighbours to the least of u and
    its neighbours; small: links u and its smaller neighbours to the least of them. The minima are
    stored so that both sides of the join are exchanged, and a vertex of many edges can be split."""
    if not large:
        both = both.filter("v < u")
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) longs in, any number of times and in either order: (node, label) out, where label is
    the least node that can be reached, for each node that isn't its own label. Loops and nulls are
    passed over."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        large = stored(_star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True), "large")
        now = stored(_star(large, False), "small")
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))

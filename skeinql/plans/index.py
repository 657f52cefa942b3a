"""Declared indexes and kept subqueries, and their substitution into queries.

An index is the structure of a query, stored once in buckets of a key's values. A query with the same
structure and an equality (or a membership, as a type filter is) on the key reads the buckets of those
values, pruned further by the key itself; all its filters stay. Structures and keys are the same if
Catalyst's canonical plans of them are, so names, blanks and the order of commutative operands don't
count, and the base's rows do. Indexes don't follow later changes of their base: drop() and add() again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .query import Among, Equals, Query

KEY, BUCKET = "_index_key", "_index_bucket"
BUCKETS = 64


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    probe: DataFrame  # the key over the structure, whose plan is compared
    frame: DataFrame


def keyed(structure: DataFrame, expression: str) -> DataFrame | None:
    try:
        return structure.select(F.expr(expression).alias(KEY))
    except AnalysisException:  # a later step makes a column that the key needs
        return None


def fits(frame: DataFrame, value: object, kind: T.DataType) -> bool:
    """Whether value is of the key's type, so that equal ones lie in equal buckets."""
    if value is None:
        return True
    own = frame.sparkSession.range(1).select(F.lit(value)).schema[0].dataType
    return own == kind or isinstance(own, T.IntegralType) and isinstance(kind, T.IntegralType)


class Indexes:
    def __init__(self, folder: str, buckets: int = BUCKETS):
        self.folder, self.buckets = folder, buckets
        self.known: dict[str, Index] = {}
        self.kept: dict[str, tuple[DataFrame, DataFrame]] = {}

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def add(self, name: str, q: Query, key: str) -> Index:
        """Store q's structure by key. Filters of q are not part of an index."""
        structure, path = q.structure, f"{self.folder}/{name}"
        # A bucket's files come from a bounded number of tasks, so a hot key is written by several.
        dealt = structure.withColumn(KEY, F.expr(key)).withColumn(BUCKET, self._bucket(F.col(KEY))).withColumn("_from", F.spark_partition_id() % 8)
        dealt.repartition(BUCKET, "_from").drop("_from").sortWithinPartitions(BUCKET, KEY).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        schema = dealt.drop("_from").schema
        self.known[name] = Index(name, tuple(structure.columns), keyed(structure, key), q.frame.sparkSession.read.schema(schema).parquet(path))
        return self.known[name]

    def keep(self, name: str, q: Query) -> None:
        """Store the rows of q: a query that is q, or has it as its structure's first part, reads them."""
        path = f"{self.folder}/{name}"
        q.df.write.mode("overwrite").parquet(path)
        self.kept[name] = q.df, q.frame.sparkSession.read.schema(q.df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self.known.pop(name, None)
        self.kept.pop(name, None)

    def optimize(self, q: Query) -> Query:
        """q, or a query that reads an index or a kept subquery in place of q's structure. Of several
        that fit, one with the longest structure counts: the steps that follow are applied as before."""
        for df, frame in self.kept.values():
            if df.columns == q.df.columns and df.sameSemantics(q.df):
                return replace(q, frame=frame, steps=(), conjuncts=(), grouping=None)
        prefixes = [q.frame]
        for s in q.steps:
            prefixes.append(s.apply(prefixes[-1]))
        for n in range(len(q.steps), -1, -1):
            for index in self.known.values():
                if index.columns == tuple(prefixes[n].columns):
                    for c in q.conjuncts:
                        if isinstance(c, Equals | Among) and (found := self._read(index, prefixes[n], c)) is not None:
                            return replace(q, frame=found, name=None, steps=q.steps[n:], grouping=None)
            for df, frame in self.kept.values():
                if n and df.columns == prefixes[n].columns and df.sameSemantics(prefixes[n]):
                    return replace(q, frame=frame, name=None, steps=q.steps[n:], grouping=None)
        return q

    def _read(self, index: Index, structure: DataFrame, c: Equals | Among) -> DataFrame | None:
        probe = keyed(structure, c.expression)
        if probe is None or not index.probe.sameSemantics(probe):
            return None
        kind = probe.schema[0].dataType
        if not all(fits(structure, v, kind) for v in c.values):
            return None
        where, key = F.lit(False), F.lit(False)
        for v in c.values:
            v = F.lit(v).try_cast(kind)
            where, key = where | (F.col(BUCKET) == self._bucket(v)), key | F.col(KEY).eqNullSafe(v)
        return index.frame.filter(where).filter(key).drop(KEY, BUCKET)

"""Comprehension-style queries over DataFrames that know what kind of collection they make.

A bag keeps duplicates, a set drops them after each operator that can make them, a seq is a bag with an
order that its positional operators use, a map has one row for each key. The structure that a query
starts with (a named base, what is unnested and joined) and its filters are kept apart until rows are
asked for, so that an index on the structure can be found whatever filters stand where.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinql.functions import scalars
from skeinql.functions.scalars import col

if TYPE_CHECKING:
    from skeinql.functions.calls import TableCall

KINDS = ("bag", "set", "seq", "map")


@dataclass(frozen=True)
class Step:
    """Part of a query's structure."""

    apply: Callable[[DataFrame], DataFrame] = field(compare=False, repr=False)


@dataclass(frozen=True)
class Equals:
    """A conjunct expression == value that an index can answer. The expression is SQL text."""

    expression: str
    value: object

    @property
    def values(self) -> tuple:
        return (self.value,)

    def column(self) -> Column:
        return F.expr(self.expression).eqNullSafe(F.lit(self.value))


@dataclass(frozen=True)
class Among:
    """A conjunct that expression is one of some values, as a type filter is; an index can answer it."""

    expression: str
    values: tuple

    def column(self) -> Column:
        e = F.expr(self.expression)
        known = e.isin([v for v in self.values if v is not None])
        return known | e.isNull() if None in self.values else known


@dataclass(frozen=True)
class Grouping:
    """What a map of groups was made of: as long as only folds of the elements are asked for, they
    are aggregates of it, and no list of a group is made."""

    df: DataFrame
    key: dict
    value: Column
    name: str
    distinct: bool

    def aggregate(self, c: Column | str) -> Column | None:
        """The aggregate that a column over the lists stands for; None if there is none."""
        text = c if isinstance(c, str) else repr(c)[len("Column<'") : -len("'>")]
        if re.fullmatch(rf"size\({re.escape(self.name)}\)", text.strip()):
            c = scalars.size(self.name)
        over, fold = c.__dict__.get("_fold", (None, None)) if isinstance(c, Column) else (None, None)
        return fold(self.value, self.distinct) if over == self.name else None

    def fused(self, columns: Sequence[Column | str], named: dict[str, Column | str]) -> DataFrame | None:
        wanted = [(c, c) if isinstance(c, str) else (None, c) for c in columns] + list(named.items())
        out, aggregates = [], []
        for name, c in wanted:
            if isinstance(c, str) and c in self.key:
                out.append(F.col(c).alias(name))
            elif name is not None and (a := self.aggregate(c)) is not None:
                aggregates.append(a.alias(f"_fold{len(out)}"))
                out.append(F.col(f"_fold{len(out)}").alias(name))
            else:
                return None
        keys = [(F.expr(k) if isinstance(k, str) else k).alias(n) for n, k in self.key.items()]
        return self.df.groupBy(*keys).agg(*aggregates).select(*out) if aggregates else None


Condition = Column | str | Equals | Among


def condition(c: Condition) -> Column:
    return c.column() if isinstance(c, Equals | Among) else F.expr(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Query:
    frame: DataFrame
    kind: str = "bag"
    name: str | None = None
    steps: tuple[Step, ...] = ()
    conjuncts: tuple[Condition, ...] = ()
    order: Sequence[str | Column] | None = None
    grouping: Grouping | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"no kind {self.kind!r}")

    @property
    def structure(self) -> DataFrame:
        out = self.frame
        for s in self.steps:
            out = s.apply(out)
        return out

    @property
    def df(self) -> DataFrame:
        out = self.structure
        for c in self.conjuncts:
            out = out.filter(condition(c))
        return out

    def _made(self, df: DataFrame, kind: str | None = None, duplicates: bool = True) -> Query:
        """What an operator makes: a base of its own, whose duplicates a set drops."""
        kind = kind or self.kind
        return Query(df.distinct() if kind == "set" and duplicates else df, kind, order=self.order if kind == "seq" else None)

    # Filters and structure

    def filter(self, *conditions: Condition) -> Query:
        return replace(self, conjuncts=(*self.conjuncts, *conditions))

    where = filter

    def unnest(self, array: str, alias: str) -> Query:
        """A row for each element of an array column; rows with none vanish."""
        step = Step(lambda df: df.withColumn(alias, F.explode(F.expr(array))))
        return replace(self, steps=(*self.steps, step))

    def let(self, name: str, value: Column | str) -> Query:
        value_column = F.expr(value) if isinstance(value, str) else value
        step = Step(lambda df: df.withColumn(name, value_column))
        return replace(self, steps=(*self.steps, step))

    def join(self, inner: Query, outer_key: str, inner_key: str) -> Query:
        """Equi join; a null key meets a null key, and rows without a partner vanish."""
        keys = (F.expr(outer_key), F.expr(inner_key))
        step = Step(lambda df: _met(df, inner.df, keys, "inner"))
        return replace(self, steps=(*self.steps, step), kind="bag" if self.kind == "map" else self.kind)

    # Products and quantifiers over another query

    def product(self, other: Query) -> Query:
        return self._made(self.df.crossJoin(other.df), duplicates=False)

    def theta(self, other: Query, on: Column | str) -> Query:
        return self._made(self.df.join(other.df, condition(on)), duplicates=False)

    def exists(self, other: Query, *on: Column | str) -> Query:
        """Rows for which other has a row that satisfies all of on; each stays as often as it was."""
        return self._made(self.df.join(other.df, _all(on), "left_semi"), duplicates=False)

    def not_exists(self, other: Query, *on: Column | str) -> Query:
        return self._made(self.df.join(other.df, _all(on), "left_anti"), duplicates=False)

    def counted_by(self, other: Query, op: str, n: int, *on: Column | str) -> Query:
        """Rows for which the number of rows of other that satisfy on compares with n. Comparisons that
        only ask whether there is one are semi and anti joins; the others count by the row itself."""
        if scalars.asks_emptiness(op, n) is not None:
            return self.not_exists(other, *on) if scalars.asks_emptiness(op, n) else self.exists(other, *on)
        own = self.df.withColumn("_row", F.struct(*self.df.columns))
        counts = own.distinct().join(other.df.withColumn("_met", F.lit(1)), _all(on), "left").groupBy("_row").agg(F.count("_met").alias("_n"))
        holds = counts.filter(scalars.COMPARE[op](F.col("_n"), F.lit(n))).select(F.col("_row").alias("_held"))
        return self._made(own.join(holds, F.col("_row").eqNullSafe(F.col("_held")), "left_semi").drop("_row"), duplicates=False)

    def forall(self, other: Query, satisfies: Column | str, *on: Column | str) -> Query:
        """Rows for which every row of other that satisfies on also satisfies the condition; an
        unknown condition isn't satisfied."""
        return self.not_exists(other, *on, ~F.coalesce(condition(satisfies), F.lit(False)))

    def member(self, value: str, other: Query, element: str) -> Query:
        return self._made(_met(self.df, other.df, (F.expr(value), F.expr(element)), "left_semi"), duplicates=False)

    def not_member(self, value: str, other: Query, element: str) -> Query:
        return self._made(_met(self.df, other.df, (F.expr(value), F.expr(element)), "left_anti"), duplicates=False)

    def lookup(self, other: Query, key: str, other_key: str, **values: str) -> Query:
        """Columns of other's row for the key; null where it has none."""
        return self._made(_met(self.df, other.df.select(F.expr(other_key).alias("_key"), *(F.expr(v).alias(k) for k, v in values.items())), (F.expr(key), F.col("_key")), "left").drop("_key"), duplicates=False)

    # Projection

    def map(self, *columns: Column | str, kind: str | None = None, **named: Column | str) -> Query:
        kind = kind or ("bag" if self.kind == "map" else self.kind)
        if self.grouping and not self.steps and not self.conjuncts and (fused := self.grouping.fused(columns, named)) is not None:
            return self._made(fused, kind)
        df = self.df.select(*(F.expr(c) if isinstance(c, str) else c for c in columns), *((F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()))
        return self._made(df, kind)

    def table_map(self, call: TableCall) -> Query:
        """A function from the rows of a partition to rows, in batches."""
        return self._made(call.over(self.df), "bag" if self.kind in ("map", "seq") else None)

    def flat_map(self, alias: str, array: Column, *keep: str) -> Query:
        """A row for each element that an expression gives."""
        return self._made(self.df.select(*keep, F.explode(array).alias(alias)), "bag" if self.kind == "map" else None)

    def collect(self, value: Column | str, name: str) -> Query:
        """A partial map: rows for which it has a value. That of a safe cast filters by type first, so
        that the filter reaches the scan or a type index."""
        column = F.expr(value) if isinstance(value, str) else value
        q = self.filter(instance) if (instance := column.__dict__.get("_instance")) is not None else self
        return q._made(q.df.select(column.alias(name)).filter(F.col(name).isNotNull()), "bag" if self.kind == "map" else None)

    # Kinds

    def to_set(self) -> Query:
        return Query(self.df.distinct(), "set")

    def to_bag(self) -> Query:
        return replace(self, kind="bag", order=None)

    def to_seq(self, *order: str | Column) -> Query:
        return replace(self, kind="seq", order=order)

    def to_map(self, key: str) -> Query:
        """One row for each key: the last, of a seq; of other kinds which one is not determined."""
        if not self.order:
            return Query(self.df.dropDuplicates([key]), "map")
        back = Window.partitionBy(key).orderBy(*(col(o).desc() for o in self.order))
        return Query(self.df.withColumn("_at", F.row_number().over(back)).filter("_at = 1").drop("_at"), "map")

    def view(self) -> Query:
        """Queries are lazy already."""
        return self

    def force(self) -> Query:
        """The rows so far, computed once and kept while the session lasts."""
        return replace(self, frame=self.df.persist(), name=None, steps=(), conjuncts=(), grouping=None)

    # Sets and bags

    def union(self, other: Query) -> Query:
        return self._made(self.df.unionByName(other.df))

    def append(self, *values: object) -> Query:
        row = self.frame.sparkSession.range(1).select(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, self.df.schema.fields, strict=True)))
        return self._made(self.df.unionByName(row))

    def difference(self, other: Query) -> Query:
        return Query(self.df.subtract(other.df), "set")

    def intersect(self, other: Query) -> Query:
        return Query(self.df.intersect(other.df), "set")

    def bag_intersect(self, other: Query) -> Query:
        return Query(self.df.intersectAll(other.df), "bag")

    def bag_difference(self, other: Query) -> Query:
        return Query(self.df.exceptAll(other.df), "bag")

    def subset_of(self, other: Query) -> bool:
        return self.df.exceptAll(other.df).isEmpty()

    def counted(self) -> Query:
        return Query(self.df.groupBy(*self.df.columns).agg(F.count("*").alias("mult")), "map")

    # Groups

    def index_by(self, **key: Column | str) -> Query:
        """A map from keys to the elements that have them, nulls among them kept."""
        return self.group_by_sel(F.struct(*self.df.columns), "elements", **key)

    def group_by_sel(self, value: Column | str, name: str, **key: Column | str) -> Query:
        element = F.expr(value) if isinstance(value, str) else value
        gather = F.collect_set if self.kind == "set" else F.collect_list
        lists = self._grouped(key).agg(F.transform(gather(F.struct(element.alias("v"))), lambda x: x["v"]).alias(name))
        return Query(lists, "map", grouping=Grouping(self.df, key, element, name, self.kind == "set"))

    def group(self, *aggregates: Column, **key: Column | str) -> Query:
        """Groups of which only aggregates are wanted: lists of elements are never made."""
        return Query(self._grouped(key).agg(*aggregates), "map")

    def _grouped(self, key: dict):
        return self.df.groupBy(*((F.expr(k) if isinstance(k, str) else k).alias(n) for n, k in key.items()))

    def fold(self, *aggregates: Column) -> Query:
        return Query(self.df.agg(*aggregates), "bag")

    def size(self) -> Query:
        return self.fold(F.count("*").alias("size"))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    # Positions

    def _window(self, partition: Sequence[str]):
        if self.kind != "seq" or not self.order:
            raise ValueError("places need a seq: call to_seq() with a total order")
        return Window.partitionBy(*partition).orderBy(*self.order)

    def zip_with_index(self, *partition: str, name: str = "index") -> Query:
        """Places from 0 in the order of the seq, of each partition for itself."""
        return replace(self._made(self.df.withColumn(name, F.row_number().over(self._window(partition)) - 1), duplicates=False), order=self.order)

    def sliding(self, n: int, *partition: str, name: str = "window") -> Query:
        """The runs of n rows; a shorter partition has one, itself."""
        df, w = self.df, self._window(partition)
        rows = F.collect_list(F.struct(*df.columns)).over(w.rowsBetween(0, n - 1))
        out = df.withColumn(name, rows).withColumn("_at", F.row_number().over(w)).filter((F.size(name) == n) | (F.col("_at") == 1)).drop("_at")
        return replace(self._made(out, duplicates=False), order=self.order)

    def head_option(self) -> Query:
        return Query(self.df.orderBy(*self._ordered()).limit(1), "bag")

    def last_option(self) -> Query:
        return Query(self.df.orderBy(*(col(o).desc() for o in self._ordered())).limit(1), "bag")

    def _ordered(self) -> Sequence[str | Column]:
        if not self.order:
            raise ValueError("places need a seq: call to_seq() with a total order")
        return self.order


def _met(a: DataFrame, b: DataFrame, keys: tuple[Column, Column], how: str) -> DataFrame:
    """A join on keys where nulls are equal."""
    return a.join(b, keys[0].eqNullSafe(keys[1]), how)


def _all(on: Sequence[Column | str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & condition(c)
    return out


def total(c: Column | str, kind: str = "long") -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast(kind)


def product(c: Column | str) -> Column:
    """Product that is 1 over nothing."""
    return F.coalesce(F.product(col(c)), F.lit(1.0))


def every(c: Column | str) -> Column:
    """True over nothing."""
    return F.coalesce(F.bool_and(col(c)), F.lit(True))


def some(c: Column | str) -> Column:
    return F.coalesce(F.bool_or(col(c)), F.lit(False))


def odd(c: Column | str) -> Column:
    """Exclusive or: whether c holds an odd number of times."""
    return F.count_if(col(c)) % 2 == 1

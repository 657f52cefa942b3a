"""Functions of the host language inside queries: opaque to the optimiser, run on Arrow batches.

A call's identity is its name and arguments, not its closure: two calls of one name are the same to
whoever compares queries, so a name must stand for one function. Built-in functions are quicker; global
ones of the engine are called by name with `global_call`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import col


@dataclass(frozen=True)
class Call:
    """f takes and returns pandas Series of equal length; nulls reach it as pandas gives them."""

    name: str
    returns: str
    f: Callable = field(compare=False)
    grouped: bool = False

    def __call__(self, *args: Column | str) -> Column:
        if self.grouped:
            return F.pandas_udf(self.f, self.returns, F.PandasUDFType.GROUPED_AGG)(*(col(a) for a in args))
        f = self.f if args else lambda like: pd.Series([self.f()] * len(like))
        return F.pandas_udf(f, self.returns, F.PandasUDFType.SCALAR)(*([col(a) for a in args] or [F.lit(0)]))


def by_row(name: str, returns: str, f: Callable) -> Call:
    """Of a function of single values; a row with a null argument gives null."""

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype="object")

    return Call(name, returns, run)


def global_call(name: str, *args: Column | str) -> Column:
    """A function that the engine knows by this name."""
    return F.call_function(name, *(col(a) for a in args))


def partial(*cases: tuple[Column, object]) -> Column:
    """A partial function: the value of the first condition that holds, null where none does."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out


def defined_at(m: Column | str, key: Column) -> Column:
    """Whether a map column has the key."""
    return F.coalesce(F.map_contains_key(col(m), key), F.lit(False))


def fold_call(name: str, returns: str, f: Callable[..., object]) -> Call:
    """An aggregate of the host language: f takes the Series of a group and returns one value. A group
    is held whole, so built-in aggregates are to be preferred."""
    return Call(name, returns, f, grouped=True)


@dataclass(frozen=True)
class TableCall:
    """A table function: f takes batches (pandas DataFrames) of a partition's rows and yields batches."""

    name: str
    schema: str
    f: Callable = field(compare=False)

    def over(self, df: DataFrame) -> DataFrame:
        return df.mapInPandas(self.f, self.schema)

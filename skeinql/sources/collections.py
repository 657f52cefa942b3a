"""Where queries start and end: tables, literals, ranges; collected values and written tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from skeinql.plans.query import Query


def table(spark: SparkSession, sf_dir: str, name: str, kind: str = "bag") -> Query:
    """A table of a folder of Parquet tables, known to indexes by its name."""
    return Query(spark.read.parquet(f"{sf_dir}/{name}.parquet"), kind, name=name)


def literal(spark: SparkSession, rows: Iterable, schema: str, kind: str = "bag", name: str | None = None) -> Query:
    """A collection given in the program; a set loses its duplicates."""
    q = Query(spark.createDataFrame(list(rows), schema), kind, name=name)
    return q.to_set() if kind == "set" else q


def int_range(spark: SparkSession, start: int, stop: int, step: int = 1, column: str = "value") -> Query:
    return Query(spark.range(start, stop, step).select(F.col("id").cast("int").alias(column)), "seq", order=[column])


def exps(spark: SparkSession, columns: Iterable[Column], name: str = "value", kind: str = "bag") -> Query:
    """A collection of computed elements."""
    q = Query(spark.range(1).select(F.explode(F.array(*columns)).alias(name)), kind)
    return q.to_set() if kind == "set" else q


def value(q: Query) -> list[Row]:
    return q.df.collect()


def write(q: Query, path: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """The query's rows as a Parquet table, read again: forces the query."""
    q.df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return q.df.sparkSession.read.parquet(path)

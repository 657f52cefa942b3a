"""Fixpoints and transitive closure, with the lineage of each round cut by a stored table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of the session in spark.checkpoint.dir. Where that is unset, a temporary folder is set
    on a single machine; on a cluster it is an error, as executors wouldn't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skeinql-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixpoint(start: DataFrame, f: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """f applied until the rows, as a set, no longer change."""
    now = kept(start.distinct())
    for _ in range(rounds):
        after = kept(f(now).distinct())
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            return after
        now = after
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """edges: two columns (from, to). All pairs that a path of one or more edges connects. Semi-naive:
    a round joins only the pairs that were new in the round before, and adds a folder of its own. Nulls meet nulls; cycles end."""
    a, b = edges.columns
    spark, folder, rounds = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/closure-{uuid.uuid4().hex}", []

    def add(df: DataFrame) -> DataFrame:
        rounds.append(f"{folder}/{len(rounds)}")
        df.write.parquet(rounds[-1])
        return spark.read.schema(edges.schema).parquet(rounds[-1])

    new = first = add(edges.distinct())
    step = first.select(F.col(a).alias("_x"), F.col(b).alias("_y"))
    while not new.isEmpty():
        longer = new.join(step, F.col(b).eqNullSafe(F.col("_x"))).select(F.col(a), F.col("_y").alias(b))
        new = add(longer.subtract(spark.read.schema(edges.schema).parquet(*rounds)))
    return spark.read.schema(edges.schema).parquet(*rounds)


def descendants(closure: DataFrame, of: object) -> DataFrame:
    """closure of (child, parent): the children of a name at any depth."""
    child, parent = closure.columns
    return closure.filter(F.col(parent).eqNullSafe(F.lit(of))).select(child)

"""Views kept up to date from a stream of changes.

A change is a row with mult +1 (included) or -1 (removed). Streams only grow, so a removal is a row too,
and a view of a multiset holds the sum of mult for each row. Stateless operators work on changes as on
rows; joins multiply mult; grouped sums and counts add changes up. Rows of mult 0 are not in the view.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MULT = "mult"


def include(df: DataFrame) -> DataFrame:
    return df.withColumn(MULT, F.lit(1).cast("long"))


def remove(df: DataFrame) -> DataFrame:
    return df.withColumn(MULT, F.lit(-1).cast("long"))


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    return remove(old).unionByName(include(new))


def reset(view: DataFrame) -> DataFrame:
    """Removes all that a view holds."""
    return view.withColumn(MULT, -F.col(MULT))


def from_log(log: DataFrame, op: str = "op") -> DataFrame:
    """A changelog with an op column of include or remove; other ops are an error."""
    wrong = F.raise_error(F.concat(F.lit("no such change: "), F.coalesce(F.col(op), F.lit("null")))).cast("long")
    return log.withColumn(MULT, F.when(F.col(op) == "include", F.lit(1)).when(F.col(op) == "remove", F.lit(-1)).otherwise(wrong).cast("long")).drop(op)


def net(changes: DataFrame) -> DataFrame:
    """The multiset that changes amount to: each row with its mult, where that isn't 0."""
    rows = [c for c in changes.columns if c != MULT]
    return changes.groupBy(*rows).agg(F.sum(MULT).alias(MULT)).filter(F.col(MULT) != 0)


def expanded(view: DataFrame) -> DataFrame:
    """The rows of a multiset, each as often as it counts."""
    return view.filter(F.col(MULT) > 0).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(MULT)))).drop("_n", MULT)


def as_set(view: DataFrame) -> DataFrame:
    return view.filter(F.col(MULT) > 0).drop(MULT)


def map_changes(changes: DataFrame, *columns: Column | str) -> DataFrame:
    return changes.select(*columns, MULT)


def joined(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Of changes or multisets: mult of a pair is the product."""
    a, b = left.withColumnRenamed(MULT, "_l"), right.withColumnRenamed(MULT, "_r")
    return a.join(b, on).withColumn(MULT, F.col("_l") * F.col("_r")).drop("_l", "_r")


def join_delta(left: DataFrame, right: DataFrame, d_left: DataFrame, d_right: DataFrame, on: Column) -> DataFrame:
    """Change of a join from the multisets before and the changes of both sides."""
    parts = [joined(d_left, right, on), joined(left, d_right, on), joined(d_left, d_right, on)]
    return net(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def derive(f: Callable[[DataFrame], DataFrame], changes: DataFrame) -> DataFrame:
    """The change of f's result. f must be linear: made of maps, filters, unnests, unions and joins with
    what doesn't change, so that f of a base and a change is the sum of f of each."""
    return net(f(changes))


def grouped(changes: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """Counts and sums by key; n is the count. Both undo removals; a key whose count is 0 is gone."""
    aggregates = [F.sum(F.expr(e) * F.col(MULT)).alias(name) for name, e in sums.items()]
    return changes.groupBy(*keys).agg(F.sum(MULT).alias("n"), *aggregates).filter("n <> 0")


def unnested(changes: DataFrame, array: str, alias: str) -> DataFrame:
    """Changes of a collection's elements: a row that comes or goes brings or takes each of them."""
    return changes.withColumn(alias, F.explode(F.expr(array)))


def _by(df: DataFrame, keys: Sequence[str], other: DataFrame, how: str) -> DataFrame:
    """A join on keys of the same names, where nulls are equal, that adds no column."""
    there = other.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(there, on, how)


def not_exists_delta(left: DataFrame, right: DataFrame, d_left: DataFrame, d_right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change of "rows of left whose keys right hasn't", from the multisets before and the changes of
    both sides. Only rows of keys that right's change touches are looked at again."""
    counts = lambda df: net(df.select(*keys, MULT))
    before, after = counts(right).filter(f"{MULT} > 0"), counts(right.unionByName(d_right)).filter(f"{MULT} > 0")
    touched = _by(left, keys, d_right, "left_semi")
    now = net(touched.unionByName(d_left))
    return net(_by(now, keys, after, "left_anti").unionByName(reset(_by(touched, keys, before, "left_anti"))))


def fold_delta(before: DataFrame, changes: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Change of a fold by key that no sum can undo (a minimum, a set): the keys that the changes touch
    are folded again, and the old result goes as the new one comes. before: the multiset."""
    touched = _by(before, keys, changes, "left_semi")
    fold = lambda view: expanded(view).groupBy(*keys).agg(*aggregates)
    return net(include(fold(net(touched.unionByName(changes)))).unionByName(remove(fold(net(touched)))))


class MaintainedView:
    """The multiset of a stream of changes, held in a table: each batch's net change is merged into the
    view before, and written as a new version. Versions are named by batch, so a batch that runs again
    after a failure starts from the version before it and gives the same one."""

    def __init__(self, path: str, transform: Callable[[DataFrame], DataFrame] = lambda changes: changes):
        self.path, self.transform = path.rstrip("/"), transform

    def versions(self, spark: SparkSession) -> list[int]:
        """The batches whose versions are complete, whoever wrote them."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        named = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("version=")]
        return sorted(int(p.getName().partition("=")[2]) for p in named if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def merge(self, changes: DataFrame, batch: int) -> None:
        """The last two versions stay: the one before is what a batch that runs again starts from."""
        spark, new = changes.sparkSession, self.transform(changes)
        known = self.versions(spark)
        if older := [v for v in known if v < batch]:
            new = spark.read.schema(new.schema).parquet(f"{self.path}/version={older[-1]}").unionByName(new)
        net(new).write.mode("overwrite").parquet(f"{self.path}/version={batch}")
        for v in older[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={v}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    def start(self, changes: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest complete version, after a restart too."""
        known = self.versions(spark)
        if not known:
            raise ValueError("no batch has been merged yet")
        return spark.read.parquet(f"{self.path}/version={known[-1]}")

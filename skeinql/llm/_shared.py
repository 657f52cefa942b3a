"""What the operators of this subpackage have in common: tables, the shared folder, and columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes of the column read that are Python values at once.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    temporary folder is set for the session on a single machine; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="skeinql-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs
    only the tasks it was running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named c0, c1, ..., which no name of an operator's own meets, and what each
    column is called now. named() undoes it."""
    own = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*own), dict(zip(df.columns, own, strict=True))


def named(df: DataFrame, of: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of df under the names that plain() took from `of`, in its types."""
    return df.select(*(F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(of.schema.fields)))


def sliced(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column `at` has about SLICE_BYTES; a single larger value is a part."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column(at).nbytes))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def appended(df: DataFrame, text: str, fields: str, start: Callable[[], Callable[[list], list[list]]], keep: bool = True) -> DataFrame:
    """df with the columns that `fields` declares, in Arrow batches; without the column `text` unless
    it is to be kept. start() runs once for each partition and returns what turns a list of that column
    into lists of the new columns."""
    new = T.StructType.fromDDL(fields)
    at, kinds = df.columns.index(text), to_arrow_schema(new)
    stay = [i for i in range(len(df.columns)) if keep or i != at]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for whole in batches:
            for b in sliced(whole, at):
                cols = make(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), *(pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True))], [*(b.schema.names[i] for i in stay), *kinds.names])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in stay), *new.fields]))

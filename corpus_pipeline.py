"""The training-corpus pipeline: quality rules, near-dedup, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages tables are written and read again, so a stage restarts from its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinql.llm._shared import stored, table
from skeinql.llm.decontamination import decontaminate
from skeinql.llm.packing import pack_documents
from skeinql.llm.pii import mask
from skeinql.llm.quality import filtered
from skeinql.llm.similar import without_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that a host's documents share."""
    return filtered(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans that benchmark items have too."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", deduplicate), ("decontamination", without_benchmark), ("pii", private), ("packing", packed)]

#: SimHash groups and packing can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents in, shuffled shards of a clean mixture out.

Each stage works on all rows that its predecessor kept, and its result is
written and read again before the next. All but the last return the columns of
``documents``; the last adds ``shard`` and ``slot``.

Null texts, empty tables, repeated rows and further columns are handled as each
operator documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hubflow.llm.common import staged, table
from hubflow.llm.decontaminate import drop_leaks
from hubflow.llm.mixing import mix
from hubflow.llm.quality import drop_rejected
from hubflow.llm.sharding import shuffled_shards
from hubflow.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the learned rules reject."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source its target; repeats are repeated rows."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all rows to shuffled shards."""
    return shuffled_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: SQL can't express the learned rules, the edit distance to item-sized windows
#: or the shuffle: tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last result isn't written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else staged(docs), sf_dir)
    return docs

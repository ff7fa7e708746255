"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.sources.sinks import shared_dir

#: What separates words: space, tab, line feed, vertical tab, form feed, return.
SEPARATORS = r"[\x20\x09-\x0D]+"


#: Staged tables that were not discarded yet.
_STAGED: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often
    ``body`` mentions it (a lambda variable is bound, an alias is inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the cluster's shared folder and
    read back: lineage is cut and later joins see its measured size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _STAGED.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    _STAGED[:] = [x for x in _STAGED if x is not df]
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard_staged() -> None:
    """Delete all tables that this program has staged. Results are lazy and read
    them, so call it once these have been written."""
    for df in list(_STAGED):
        discard(df)


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

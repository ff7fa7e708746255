"""Table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_source(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a catalog table (``db.table``) or a parquet path, keeping only
    ``columns``. Selecting early lets the scan read just those columns; filters
    applied afterwards are pushed into the parquet reader by Catalyst."""
    if "/" in name or name.endswith(".parquet"):
        df = spark.read.parquet(name)
    else:
        df = spark.table(name)
    return df.select(*columns) if columns else df

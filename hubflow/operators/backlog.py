"""Station dimension and backlog operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.functions.codes import hub_code
from hubflow.operators.filters import drop_sentinels

HUB_PREFIX = "HUB"  # fixed: code prefix of hub rows in the station dimension


def station_dim(stations: DataFrame) -> DataFrame:
    """Clean station dimension: sentinel ids dropped, id as BIGINT (``try_cast``:
    an unexpected text gives NULL instead of failing the job), renamed
    columns and the hub code of each station."""
    return drop_sentinels(stations, "station_id").select(
        F.col("station_id").try_cast("bigint").alias("station_id"),
        F.col("regional").alias("lm_regional"),
        "sub_regional",
        "superior_station_code",
        "station_name",
        F.col("station_code").alias("code_name"),
        hub_code("station_code", "superior_station_code").alias("superior_code_hub"),
    )


def max_per_key(df: DataFrame, key: str, order: str, alias: str = "max_sequence") -> DataFrame:
    """MAX(order) per key. Partial aggregation runs map-side, so a hot key
    costs one row per task in the shuffle."""
    return df.groupBy(key).agg(F.max(order).alias(alias))


def latest_per_key(rows: DataFrame, key: str, order: str, within: DataFrame | None = None) -> DataFrame:
    """Rows of ``rows`` whose ``order`` equals the maximum of their ``key``,
    taken over ``within`` (default: ``rows`` itself); ties are all kept and
    NULL keys drop.

    Written as MAX per key + left-semi join instead of a window function: the
    max side is one row per key after map-side partial aggregation, and AQE can
    split a skewed key on the big side of the join, which a window partition
    cannot."""
    src = rows if within is None else within
    mx = src.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_max"))
    cond = (rows[key] == mx["_key"]) & (rows[order] == mx["_max"])
    return rows.join(mx, cond, "left_semi")


def latest_snapshot(df: DataFrame, date_col: str = "grass_date") -> DataFrame:
    """Rows of a dated dimension at its latest date: a filter on the global
    MAX, given as an uncorrelated scalar subquery (one value, computed once
    by its own small aggregation job; no join and nothing collected by the
    caller)."""
    latest = df.agg(F.max(date_col)).scalar()
    return df.filter(F.col(date_col) == latest)


def hub_rows(dim: DataFrame) -> DataFrame:
    """Hub rows of the clean station dimension, keyed by hub code."""
    return dim.filter(F.col("code_name").startswith(HUB_PREFIX)).select(
        F.col("superior_code_hub").alias("hub_key"),
        F.col("station_id").alias("hub_station_id"),
        F.col("station_name").alias("hub_station_name"),
        F.col("superior_station_code").alias("hub_superior_station_code"),
    )


def hub_lookup(df: DataFrame, hubs: DataFrame, code_col: str = "superior_code_hub") -> DataFrame:
    """Left join each row to the hub rows of its hub code. Several hub rows per
    code each give a row; no match keeps the row with NULL hub columns."""
    return df.join(hubs, df[code_col] == hubs["hub_key"], "left").drop("hub_key")


def status_pivot(df: DataFrame, keys: Sequence, metrics: dict[str, Column], id_col: str = "shipment_id") -> DataFrame:
    """One pass, one row per key: for each metric, the count of rows meeting
    its condition with a non-NULL ``id_col``. Metrics may overlap."""
    aggs = [F.count(F.when(cond, F.col(id_col))).alias(name) for name, cond in metrics.items()]
    return df.groupBy(*keys).agg(*aggs)

"""Hour profiles, window totals and hourly shares.

The profile is the only aggregation over the facts: Spark plans its
``count_distinct`` as a partial dedupe on (group keys, shipment id), a
shuffle on those keys, then a count, so one very large station/day/hour
group is spread over many tasks. Totals and shares work on the profile,
which is at (station, day, window, hour) grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.functions.rates import share_pct
from hubflow.operators.filters import drop_label

JOIN_KEYS = ["station_id", "window_date", "window_label"]


def hour_profile(events: DataFrame, ts_col: str, keys: Sequence[str], id_col: str = "shipment_id") -> DataFrame:
    """Per ``keys`` and hour of day: first instant (``first_at``) and distinct
    ids (``shipments``)."""
    return events.groupBy(*keys, F.hour(ts_col).alias("hour")).agg(
        F.min(ts_col).alias("first_at"),
        F.count_distinct(id_col).alias("shipments"),
    )


def window_totals(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the hourly counts per window; outside rows excluded."""
    return drop_label(profile).groupBy(*keys).agg(F.sum("shipments").alias("window_total"))


def window_shares(
    profile: DataFrame,
    keys: Sequence[str],
    join_keys: list[str] = JOIN_KEYS,
    share_scale: int | None = None,
) -> DataFrame:
    """``hour_shares(profile, window_totals(profile, keys))`` without reading
    the profile twice: the totals are window sums over ``keys``, and every row
    meets those of its ``join_keys`` as a set. One exchange on ``join_keys``
    serves both, and any later grouping on a superset. A key holds at most 24
    hours of the planned windows of one station-day, so neither the exchange
    nor the set can be skewed."""
    known = drop_label(profile).dropna(subset=join_keys).repartition(*join_keys)
    return shares_of(known, keys, join_keys, share_scale)


def shares_of(known: DataFrame, keys: Sequence[str], join_keys: Sequence[str], share_scale: int | None = None) -> DataFrame:
    """As ``window_shares``, of hours whose label is known; nothing is exchanged
    if ``known`` is partitioned by ``join_keys``."""
    rest = [k for k in keys if k not in join_keys]
    total = F.sum("shipments").over(Window.partitionBy(*keys))
    totals = F.collect_set(F.struct(*rest, "_total")).over(Window.partitionBy(*join_keys))
    rows = known.withColumn("_total", total).withColumn("_totals", totals)
    return rows.select(*known.columns, F.explode("_totals._total").alias("window_total")).select(
        "*", share_pct("shipments", "window_total", share_scale).alias("share")
    )


def hour_shares(
    profile: DataFrame,
    totals: DataFrame,
    share_scale: int | None = None,
    join_keys: list[str] = JOIN_KEYS,
) -> DataFrame:
    """Each hour's share (0-100, 2 decimals) of its window total.

    Totals are grouped by the full window keys but matched on station, day
    and expanded label only, as in the source job: two planned windows with the
    same expanded label each see both totals."""
    t = totals.select(*join_keys, "window_total")
    return (
        drop_label(profile)
        .join(t, join_keys)
        .select("*", share_pct("shipments", "window_total", share_scale).alias("share"))
    )

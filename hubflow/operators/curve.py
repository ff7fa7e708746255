"""Curve statistics per window: real span, the volume of the hours that carry
more than ``volume_pct`` percent, and the span of the hours above
``span_pct`` percent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.functions.clock import label_clock, minutes_between
from hubflow.operators.filters import drop_label


def _one_day() -> Column:
    return F.make_dt_interval(F.lit(1))


def overnight_start(ts, label) -> Column:
    """Start instant for a planned label that passes midnight (start hour >
    end hour): hours before the start hour move one day later."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    sh, eh = label_clock(label, "start_hour"), label_clock(label, "end_hour")
    return F.when(sh > eh, F.when(F.hour(ts) >= sh, ts).otherwise(ts + _one_day())).otherwise(ts)


def overnight_end(ts, label) -> Column:
    """End instant for a label that passes midnight: hours after the end hour
    move one day earlier."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    sh, eh = label_clock(label, "start_hour"), label_clock(label, "end_hour")
    return F.when(sh > eh, F.when(F.hour(ts) <= eh, ts).otherwise(ts - _one_day())).otherwise(ts)


def curve_stats(
    shares: DataFrame,
    keys: Sequence[str],
    volume_pct: float = 5,
    span_pct: float = 5,
    shift_label: str | None = None,
    shift_if: Column | None = None,
) -> DataFrame:
    """One row per window. Real start/end are the first and last hourly first
    instants (``shift_label`` applies the overnight shift to them first, on
    the rows where ``shift_if`` holds, default all);
    ``curve_*`` use only hours whose share exceeds ``span_pct``."""
    ts = F.col("first_at")
    start, end = ts, ts
    if shift_label is not None:
        start, end = overnight_start(ts, F.col(shift_label)), overnight_end(ts, F.col(shift_label))
        if shift_if is not None:
            start, end = F.when(shift_if, start).otherwise(ts), F.when(shift_if, end).otherwise(ts)
    above_span = F.col("share") > span_pct
    return (
        drop_label(shares)
        .groupBy(*keys)
        .agg(
            F.min(start).alias("real_start"),
            F.max(end).alias("real_end"),
            F.sum(F.when(F.col("share") > volume_pct, F.col("shipments")).otherwise(0)).alias("curve_volume"),
            F.count_distinct("hour").alias("hour_count"),
            F.sum("shipments").alias("volume"),
            F.min(F.when(above_span, ts)).alias("curve_start"),
            F.max(F.when(above_span, ts)).alias("curve_end"),
        )
        .select(
            "*",
            minutes_between("real_start", "real_end").alias("real_minutes"),
            minutes_between("curve_start", "curve_end").alias("curve_minutes"),
        )
    )

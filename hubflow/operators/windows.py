"""Planned daily windows: cleaning, int bounds, one-hour expansion, labels.

The planning sheet is a small dimension (stations x windows); the operators
here are per-row Column expressions plus one ``distinct``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.clock import (
    clock_text,
    expand_close,
    expand_open,
    hhmm_from_text,
    pad4,
    span_label,
)
from hubflow.operators.filters import require_text

RAW_COLUMNS = {
    "receive_start_text": "labeling_start_time",
    "receive_end_text": "labeling_end_time",
    "dispatch_start_text": "dispatching_start_time_fleet",
    "dispatch_end_text": "dispatching_end_time_fleet",
}


def planned_windows(planning: DataFrame) -> DataFrame:
    """Distinct windows per station as 'HH:MM' texts; rows with a NULL or
    empty time are dropped."""
    clean = require_text(planning, *RAW_COLUMNS.values())
    return clean.select(
        F.col("station_id").cast("string").alias("station_id"),
        *[clock_text(raw).alias(name) for name, raw in RAW_COLUMNS.items()],
    ).distinct()


def _side(prefix: str):
    """Bounds, expanded bounds and labels of one side ('receive'/'dispatch')."""
    start = hhmm_from_text(F.col(f"{prefix}_start_text"))
    end = hhmm_from_text(F.col(f"{prefix}_end_text"))
    return [
        start.alias(f"{prefix}_start"),
        end.alias(f"{prefix}_end"),
        expand_open(start).alias(f"{prefix}_open"),
        expand_close(end).alias(f"{prefix}_close"),
    ]


def _labels(prefix: str):
    return [
        pad4(f"{prefix}_open").alias(f"{prefix}_open_text"),
        pad4(f"{prefix}_close").alias(f"{prefix}_close_text"),
        span_label(f"{prefix}_start_text", f"{prefix}_end_text").alias(f"{prefix}_planned"),
        span_label(pad4(f"{prefix}_open"), pad4(f"{prefix}_close")).alias(f"{prefix}_expanded"),
    ]


def expanded_windows(windows: DataFrame) -> DataFrame:
    """Add int bounds (NULL when unparsable), the window widened by one hour on
    each side (clamped to 23:30 / 23:59), and the labels: padded expanded
    bounds, the planned label 'a às b' and the expanded label 'HHMM às HHMM'."""
    with_bounds = windows.select("*", *_side("receive"), *_side("dispatch"))
    return with_bounds.select("*", *_labels("receive"), *_labels("dispatch"))


def window_table(planning: DataFrame) -> DataFrame:
    """``expanded_windows(planned_windows(planning))``."""
    return expanded_windows(planned_windows(planning))

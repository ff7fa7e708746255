"""Distinct operators who scanned during a window.

The source job joins windows to scans on the station plus an OR of two time
ranges (same day, and the next day for windows that pass midnight). Here
each window-day becomes one or two intervals keyed by (station, scan day);
the two cases have different scan days, so they never overlap and the
rewrite is exact.

Windows of a station overlap, so scans don't meet intervals. The bounds of all
intervals, and the hours, cut a station-day into elementary intervals; each scan
is placed in exactly one of them, and of the scans only the distinct (elementary interval,
operator) are kept. These fan out to the windows that cover the interval. So a
scan is one row however many windows overlap, and the fan-out is bounded by
intervals and operators, not by scans.

Scans find their interval among the cuts of their hour, in an equi-join on
(station, scan day, hour), never through a nested loop. Which side is broadcast,
if any, is the planner's choice from measured sizes; a shuffled join has an
exchange of its own, in which AQE splits skewed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.functions.clock import label_clock, label_instant
from hubflow.operators.filters import first_attempt


def operator_scans(scans: DataFrame) -> DataFrame:
    """Distinct first-attempt scans: station (text), scan day, instant, operator."""
    return (
        first_attempt(scans, "bin_received_attempt")
        .select(
            F.col("station_id").cast("string").alias("station_id"),
            F.to_date("datetime").alias("scan_date"),
            F.col("datetime").alias("scan_at"),
            "operator_name",
        )
        .distinct()
    )


def scan_rows(scans: DataFrame) -> DataFrame:
    """First-attempt scans with an operator. No dedupe: only distinct
    operators are counted later, which duplicates do not change."""
    return first_attempt(scans, "bin_received_attempt").filter(F.col("operator_name").isNotNull()).select(
        F.col("station_id").cast("string").alias("station_id"),
        F.to_date("datetime").alias("scan_date"),
        F.col("datetime").alias("scan_at"),
        "operator_name",
    )


def window_intervals(windows: DataFrame, label_col: str, next_day=True) -> DataFrame:
    """(station_id, window_date, label, ...) -> one row per scan interval:
    ``scan_date``, ``lo``, ``hi``. Same day: the label's start..end on the
    window day. Next day (when the start hour is after the end hour):
    midnight..end on the following day. Unparsable labels give no row.
    ``next_day`` may be a Column: the next-day case then applies to the rows
    where it holds."""
    day = F.col("window_date")
    label = F.col(label_col)
    same = F.struct(
        day.alias("scan_date"),
        label_instant(day, label, "start").alias("lo"),
        label_instant(day, label, "end").alias("hi"),
    )
    parts = [same]
    if next_day is not False:
        nxt = F.date_add(day, 1)
        wraps = label_clock(label, "start_hour") > label_clock(label, "end_hour")
        if next_day is not True:
            wraps = wraps & next_day
        parts.append(
            F.when(
                wraps,
                F.struct(
                    nxt.alias("scan_date"),
                    nxt.cast("timestamp_ntz").alias("lo"),
                    label_instant(nxt, label, "end").alias("hi"),
                ),
            )
        )
    keep = [c for c in windows.columns]
    return (
        windows.select(*keep, F.explode(F.array(*parts)).alias("iv"))
        .select(*keep, "iv.scan_date", "iv.lo", "iv.hi")
        .filter(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    )


def _after(instant: str) -> Column:
    """The instant at which an interval that ends with ``instant`` is over."""
    return F.col(instant) + F.make_dt_interval(secs=F.lit(0.000001))


def hour_cuts(intervals: DataFrame) -> DataFrame:
    """One row per station, scan day and hour in which intervals begin or are
    over, with these instants (``cuts``). Labels name minutes, so an hour has at
    most two cuts for each."""
    bounds = intervals.filter("lo <= hi").select("station_id", "scan_date", F.explode(F.array(F.col("lo"), _after("hi"))).alias("cut"))
    return bounds.groupBy("station_id", "scan_date", F.hour("cut").alias("hour")).agg(F.collect_set("cut").alias("cuts"))


def scan_segments(scans: DataFrame, cuts: DataFrame) -> DataFrame:
    """Distinct (station, scan day, elementary interval, operator) of
    ``scan_rows``. An interval is named by the instant at which it begins: a cut,
    or the hour."""
    placed = scans.withColumn("hour", F.hour("scan_at")).join(cuts, ["station_id", "scan_date", "hour"], "left")
    cut = F.array_max(F.filter("cuts", lambda c: c <= F.col("scan_at")))
    segment = F.greatest(F.date_trunc("hour", F.col("scan_at")).cast("timestamp_ntz"), cut)
    return placed.select("station_id", "scan_date", segment.alias("segment"), "operator_name").distinct()


def count_operators(
    windows: DataFrame, label_col: str, group_keys: list[str], next_day, scans: DataFrame
) -> DataFrame:
    """Distinct operators per ``group_keys`` among scans that fall in the
    interval(s) of each row of ``windows`` (station_id, window_date, label),
    which is read twice."""
    intervals = window_intervals(windows, label_col, next_day)
    segments = scan_segments(scan_rows(scans), hour_cuts(intervals))
    return (
        segments.join(intervals, ["station_id", "scan_date"])
        .filter(F.col("segment").between(F.col("lo"), F.col("hi")))
        .groupBy(*group_keys)
        .agg(F.count_distinct("operator_name").alias("operators"))
    )


def operators_per_window(shares: DataFrame, scans: DataFrame) -> DataFrame:
    """Distinct operators per (station, window day, expanded label) during the
    planned receive window (both cases). Planned windows sharing an expanded
    label pool their operators; windows without operators get no row."""
    wins = shares.select("station_id", "window_date", "window_label", "receive_planned").distinct()
    return count_operators(wins, "receive_planned", ["station_id", "window_date", "window_label"], True, scans)


def operators_in_dispatch(dispatch_shares: DataFrame, scans: DataFrame) -> DataFrame:
    """Distinct operators scanning on the window day between the planned
    dispatch start and end (no next-day case), per (station, window day,
    planned dispatch label); 0 when none."""
    keys = ["station_id", "window_date", "dispatch_planned"]
    wins = dispatch_shares.select(*keys).distinct()
    counts = count_operators(wins, "dispatch_planned", keys, False, scans)
    return wins.join(counts, keys, "left").select(*keys, F.coalesce("operators", F.lit(0)).alias("operators"))

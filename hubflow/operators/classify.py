"""Receipts and dispatches placed in planned windows.

Each fact row meets every window of its station, is flagged inside or outside
and given the business date of its window. The rules of each direction are
Columns defined once (``receive_*``, ``dispatch_*``) and used by the
per-direction operators and by the one-pass frames alike.

The join on the station is left to the planner: a windows table under the
broadcast threshold is broadcast, a larger one is shuffled and AQE splits the
stations that hold very many facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.functions.clock import OUTSIDE_LABEL, base_date, clock_int, inside_cyclic
from hubflow.operators.filters import in_rolling_days, is_first_attempt
from hubflow.operators.joins import anti_join
from hubflow.operators.segments import DISPATCH, RECEIVE

RECEIPT_KEYS = ["station_id", "window_date", "window_label", "receive_planned", "receive_expanded"]
DISPATCH_KEYS = ["station_id", "window_date", "window_label", "dispatch_planned", "dispatch_expanded"]


def is_receipt(as_of=None, first: int = 30, last: int = 1) -> Column:
    """First-attempt receipts of the last ``first``..``last`` days (by ``data``)."""
    return is_first_attempt("received_attempt") & in_rolling_days("data", as_of, first, last)


def is_dispatch() -> Column:
    """First-attempt dispatches (no date limit)."""
    return is_first_attempt("delivering_attempt")


def receive_inside(hm) -> Column:
    """Inside the expanded receive window, with the midnight wrap."""
    return inside_cyclic(hm, "receive_open", "receive_close")


def receive_date(at, hm) -> Column:
    """The part after midnight of a wrapping window belongs to the day before;
    outside both parts there is no date."""
    return base_date(F.to_date(at), hm, "receive_open", "receive_close")


def dispatch_inside(hm) -> Column:
    """Inside the planned (not expanded) dispatch window; NULL bounds give 0."""
    return inside_cyclic(hm, "dispatch_start", "dispatch_end")


def dispatch_date(at, hm) -> Column:
    """As ``receive_date``, but outside both parts the own date stays."""
    return base_date(F.to_date(at), hm, "dispatch_start", "dispatch_end", default_own_day=True)


def receipt_rows(shipments: DataFrame, as_of=None, first: int = 30, last: int = 1) -> DataFrame:
    """``is_receipt`` rows with the station id as text and the receive clock."""
    return shipments.filter(is_receipt(as_of, first, last)).select(
        F.col("station_id").cast("string").alias("station_id"),
        "shipment_id",
        F.col("data").alias("received_date"),
        clock_int("datetime_received").alias("received_hhmm"),
        F.col("datetime_received").alias("received_at"),
    )


def dispatch_rows(shipments: DataFrame) -> DataFrame:
    """``is_dispatch`` rows with the station id as text and the dispatch clock."""
    return shipments.filter(is_dispatch()).select(
        F.col("station_id").cast("string").alias("station_id"),
        "shipment_id",
        F.col("data").alias("delivered_date"),
        clock_int("datetime_delivering").alias("delivered_hhmm"),
        F.col("datetime_delivering").alias("delivered_at"),
    )


def classify_receipts(receipts: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per (receipt, window of its station) with ``receive_inside`` and
    ``receive_date``."""
    w = windows.select(
        "station_id", "receive_open", "receive_close", "receive_start", "receive_end",
        "receive_planned", "receive_expanded",
    )
    return receipts.join(w, "station_id").select(
        "station_id", "shipment_id", "received_at", "received_date", "received_hhmm",
        "receive_open", "receive_close", "receive_start", "receive_end",
        "receive_planned", "receive_expanded",
        F.col("receive_expanded").alias("window_label"),
        receive_inside("received_hhmm").alias("inside"),
        receive_date("received_at", "received_hhmm").alias("window_date"),
    )


def classify_dispatches(dispatches: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per (dispatch, window of its station) with ``dispatch_inside`` and
    ``dispatch_date``. The grouping label is the window's *receive* expanded
    label."""
    w = windows.select(
        "station_id", "receive_open", "receive_close", "dispatch_start", "dispatch_end",
        "dispatch_planned", "dispatch_expanded", "receive_expanded",
    )
    return dispatches.join(w, "station_id").select(
        "station_id", "shipment_id", "delivered_at", "delivered_date", "delivered_hhmm",
        "receive_open", "receive_close", "dispatch_start", "dispatch_end",
        "dispatch_planned", "dispatch_expanded",
        F.col("receive_expanded").alias("window_label"),
        dispatch_inside("delivered_hhmm").alias("inside"),
        dispatch_date("delivered_at", "delivered_hhmm").alias("window_date"),
    )


def receipts_inside(classified: DataFrame) -> DataFrame:
    """Receipts inside a window, at the grain of the hour profile."""
    return classified.filter(F.col("inside") == 1).select(
        "station_id", "shipment_id", "window_date", "received_at",
        "window_label", "receive_planned", "receive_expanded",
    )


def dispatches_inside(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("inside") == 1).select(
        "station_id", "shipment_id", "window_date", "delivered_at",
        "window_label", "dispatch_planned", "dispatch_expanded",
    )


def receipts_outside(receipts: DataFrame, inside: DataFrame) -> DataFrame:
    """Receipts whose shipment id is inside no window at all (any station,
    any window), labelled ``'fora da janela'``; NULL ids are inside none."""
    return anti_join(receipts, inside, "shipment_id").select(
        "station_id", "shipment_id",
        F.col("received_date").alias("window_date"),
        "received_at",
        F.lit(OUTSIDE_LABEL).alias("window_label"),
        F.lit(None).cast("string").alias("receive_planned"),
        F.lit(None).cast("string").alias("receive_expanded"),
    )


def all_receipts(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Inside and outside receipts, one frame (UNION ALL)."""
    return inside.unionByName(outside)


# --- both directions in one pass ---------------------------------------------


def fact_events(shipments: DataFrame, as_of=None, first: int = 30, last: int = 1) -> DataFrame:
    """Receipts and dispatches of the shipment facts from one scan: each fact
    row gives a 'receive' event (first receive attempt, ``data`` within the
    rolling range) and/or a 'dispatch' event (first delivery attempt, no date
    limit)."""
    receive_ok, dispatch_ok = is_receipt(as_of, first, last), is_dispatch()
    events = F.array(
        F.when(receive_ok, F.struct(F.lit(RECEIVE).alias("direction"), F.col("datetime_received").alias("at"))),
        F.when(dispatch_ok, F.struct(F.lit(DISPATCH).alias("direction"), F.col("datetime_delivering").alias("at"))),
    )
    # plain explode + null filter: stays in whole-stage codegen (a lambda
    # filter on the array would be evaluated row by row)
    return (
        shipments.filter(receive_ok | dispatch_ok)
        .select(
            F.col("station_id").cast("string").alias("station_id"),
            "shipment_id",
            F.explode(events).alias("e"),
        )
        .filter(F.col("e").isNotNull())
        .select(
            "e.direction", "station_id", "shipment_id",
            F.col("e.at").alias("event_at"),
            clock_int("e.at").alias("event_hhmm"),
        )
    )

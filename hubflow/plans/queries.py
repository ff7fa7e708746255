"""Registered queries: one per operator of the inventory, each
``(spark, sf_dir) -> DataFrame`` over the test tables in ``sf_dir``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.operators.backlog import (
    hub_lookup,
    hub_rows,
    latest_per_key,
    latest_snapshot,
    max_per_key,
    station_dim,
    status_pivot,
)
from hubflow.operators.classify import (
    DISPATCH_KEYS,
    RECEIPT_KEYS,
    all_receipts,
    classify_dispatches,
    classify_receipts,
    dispatch_rows,
    dispatches_inside,
    receipt_rows,
    receipts_inside,
    receipts_outside,
)
from hubflow.operators.curve import curve_stats, overnight_end, overnight_start
from hubflow.operators.filters import drop_label, first_attempt, rolling_days, slice_dim, status_in
from hubflow.operators.profile import hour_profile, window_totals
from hubflow.operators.staffing import (
    operator_scans,
    operators_in_dispatch,
    operators_per_window,
    window_intervals,
)
from hubflow.operators.windows import planned_windows, window_table
from hubflow.functions.codes import prefix_any, trim_marker
from hubflow.plans.backlog import (
    BACKLOG_CODES,
    DESTINATION_PREFIXES,
    LOCATION_PREFIXES,
    SNAPSHOT_SLICE,
    backlog_candidates,
    backlog_report,
    backlog_rows,
    metric_conditions,
)
from hubflow.plans.shift import (
    CURVE_SPAN_PCT,
    SHIFT_SPAN_PCT,
    VOLUME_PCT,
    curve_productivity,
    dispatch_share_frame,
    receipt_share_frame,
    shift_productivity,
)
from hubflow.sources.sinks import materialize, shared_dir
from hubflow.sources.tables import read_source
from hubflow.sources.testdata import AS_OF, AS_OF_TS, Inputs, load_inputs

# fixed value: the rolling-range query uses an as-of date inside the data, so
# that both ends of the range cut rows
ROLLING_AS_OF = "2024-01-20"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def wrap(fn: Callable[[Inputs], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_inputs(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run

    return wrap


def _windows(inp: Inputs) -> DataFrame:
    return window_table(inp.planning)


def _receipts(inp: Inputs) -> DataFrame:
    return receipt_rows(inp.shipments, AS_OF)


def _classified_receipts(inp: Inputs) -> DataFrame:
    return classify_receipts(_receipts(inp), _windows(inp))


def _all_receipts(inp: Inputs) -> DataFrame:
    inside = receipts_inside(_classified_receipts(inp))
    return all_receipts(inside, receipts_outside(_receipts(inp), inside))


def _receipt_profile(inp: Inputs) -> DataFrame:
    return hour_profile(_all_receipts(inp), "received_at", RECEIPT_KEYS)


def _receipt_shares(inp: Inputs) -> DataFrame:
    return receipt_share_frame(inp, _windows(inp), AS_OF)


def _inside_dispatches(inp: Inputs) -> DataFrame:
    return dispatches_inside(classify_dispatches(dispatch_rows(inp.shipments), _windows(inp)))


def _dispatch_profile(inp: Inputs) -> DataFrame:
    return hour_profile(_inside_dispatches(inp), "delivered_at", DISPATCH_KEYS)


def _dispatch_shares(inp: Inputs) -> DataFrame:
    return dispatch_share_frame(inp, _windows(inp))


def _regional(inp: Inputs) -> DataFrame:
    dim = station_dim(inp.stations)
    return dim.select(F.col("station_id").alias("r_station_id"), "superior_code_hub")


def _with_regional(inp: Inputs) -> DataFrame:
    r = _regional(inp)
    t = inp.tracking
    return t.join(r, t["final_spx_station_id"].try_cast("bigint") == r["r_station_id"], "left").drop("r_station_id")


# --- sources and filters ----------------------------------------------------
@query("scan_shipments")
def _scan_shipments(inp):
    """Catalog scan of the shipment facts with a column subset."""
    inp.shipments.createOrReplaceTempView("shipment_facts")
    spark = inp.shipments.sparkSession
    return read_source(spark, "shipment_facts", ["station_id", "shipment_id", "data", "datetime_received"])


@query("first_attempt")
def _first_attempt(inp):
    """First receive attempts."""
    return first_attempt(inp.shipments, "received_attempt")


@query("rolling_days")
def _rolling_days(inp):
    """Facts dated as_of-30 .. as_of-1."""
    return rolling_days(inp.shipments, "data", ROLLING_AS_OF)


@query("clock_int")
def _clock_int(inp):
    """Receipts with their HHMM clock."""
    return _receipts(inp)


@query("planned_windows")
def _planned_windows(inp):
    """Distinct planned windows, rows without a time dropped."""
    return planned_windows(inp.planning)


@query("expanded_windows")
def _expanded_windows(inp):
    """Bounds, expanded bounds and labels of the planned windows."""
    return window_table(inp.planning)


@query("station_dim")
def _station_dim(inp):
    """The clean station dimension."""
    return station_dim(inp.stations)


@query("latest_snapshot")
def _latest_snapshot(inp):
    """The snapshot's latest date, local rows of the region."""
    return slice_dim(latest_snapshot(inp.snapshot), **SNAPSHOT_SLICE)


# --- receive path -------------------------------------------------------------
@query("receipts_classified")
def _receipts_classified(inp):
    """Receipts x windows with flag and window date."""
    return _classified_receipts(inp)


@query("receipts_inside")
def _receipts_inside(inp):
    """Receipts inside a window."""
    return receipts_inside(_classified_receipts(inp))


@query("receipts_outside")
def _receipts_outside(inp):
    """Receipts inside no window (anti-join on the shipment id)."""
    return receipts_outside(_receipts(inp), receipts_inside(_classified_receipts(inp)))


@query("all_receipts")
def _all(inp):
    """Inside and outside receipts."""
    return _all_receipts(inp)


@query("receipt_profile")
def _receipt_profile_q(inp):
    """Hour profile of all receipts."""
    return _receipt_profile(inp)


@query("drop_label")
def _drop_label(inp):
    """Hour profile without the outside label."""
    return drop_label(_receipt_profile(inp))


@query("receipt_totals")
def _receipt_totals(inp):
    """Window totals of receipts."""
    return window_totals(_receipt_profile(inp), RECEIPT_KEYS)


@query("receipt_shares")
def _receipt_shares_q(inp):
    """Hourly shares of receipt windows."""
    return _receipt_shares(inp)


@query("curve_stats")
def _curve_stats(inp):
    """O52 with the curve span of the curve job (5 %)."""
    return curve_stats(_receipt_shares(inp), RECEIPT_KEYS, VOLUME_PCT, CURVE_SPAN_PCT)


@query("curve_stats_low")
def _curve_stats_low(inp):
    """O52 with the curve span of the shift job (0.05 %)."""
    return curve_stats(_receipt_shares(inp), RECEIPT_KEYS, VOLUME_PCT, SHIFT_SPAN_PCT)


@query("label_instants")
def _label_instants(inp):
    """Scan intervals of each receive window day from its planned label."""
    wins = _receipt_shares(inp).select("station_id", "window_date", "window_label", "receive_planned").distinct()
    return window_intervals(wins, "receive_planned", next_day=True)


@query("operator_scans")
def _operator_scans(inp):
    """Distinct first-attempt scans."""
    return operator_scans(inp.scans)


@query("operators_per_window")
def _operators_per_window(inp):
    """Distinct operators per receive window day."""
    return operators_per_window(materialize(_receipt_shares(inp)), inp.scans)


# --- dispatch path --------------------------------------------------------------
@query("dispatches_classified")
def _dispatches_classified(inp):
    """Dispatches x windows with flag and window date."""
    return classify_dispatches(dispatch_rows(inp.shipments), _windows(inp))


@query("dispatches_inside")
def _dispatches_inside(inp):
    """O07 on dispatches."""
    return _inside_dispatches(inp)


@query("dispatch_profile")
def _dispatch_profile_q(inp):
    """Hour profile of dispatches."""
    return _dispatch_profile(inp)


@query("dispatch_totals")
def _dispatch_totals(inp):
    """O51 on dispatches."""
    return window_totals(_dispatch_profile(inp), DISPATCH_KEYS)


@query("dispatch_shares")
def _dispatch_shares_q(inp):
    """O40 on dispatches (matched on the receive expanded label)."""
    return _dispatch_shares(inp)


@query("overnight_shift")
def _overnight_shift(inp):
    """Dispatch hour instants shifted for windows passing midnight."""
    s = _dispatch_shares(inp)
    return s.select(
        *s.columns,
        overnight_start("first_at", F.col("dispatch_planned")).alias("shifted_start"),
        overnight_end("first_at", F.col("dispatch_planned")).alias("shifted_end"),
    )


@query("dispatch_curve_stats")
def _dispatch_curve_stats(inp):
    """O53 with the curve span of the curve job (5 %)."""
    return curve_stats(_dispatch_shares(inp), DISPATCH_KEYS, VOLUME_PCT, CURVE_SPAN_PCT, "dispatch_planned")


@query("dispatch_curve_stats_low")
def _dispatch_curve_stats_low(inp):
    """O53 with the curve span of the shift job (0.05 %)."""
    return curve_stats(_dispatch_shares(inp), DISPATCH_KEYS, VOLUME_PCT, SHIFT_SPAN_PCT, "dispatch_planned")


@query("operators_in_dispatch")
def _operators_in_dispatch(inp):
    """Distinct operators in the planned dispatch window, 0 when none."""
    return operators_in_dispatch(materialize(_dispatch_shares(inp)), inp.scans)


# --- reports ----------------------------------------------------------------------
@query("station_lookup")
def _station_lookup(inp):
    """Receipts joined to the station dimension on the id as text."""
    r = _receipts(inp)
    dim = station_dim(inp.stations)
    return r.join(dim, r["station_id"] == dim["station_id"].cast("string"), "left").select(
        r["station_id"], "shipment_id", "received_date", "lm_regional", "sub_regional",
        dim["station_name"], "code_name",
    )


@query("shift_report")
def _shift_report(inp):
    """Q1: shift productivity report."""
    return shift_productivity(inp, AS_OF)


@query("curve_report")
def _curve_report(inp):
    """Q2: curve productivity report."""
    return curve_productivity(inp, AS_OF)


@query("full_refresh")
def _full_refresh(inp):
    """Q1 written with a full refresh into the shared folder, read back."""
    spark = inp.shipments.sparkSession
    target = f"{shared_dir(spark)}/hubflow-tables/shift_report-{uuid.uuid4().hex}"
    return shift_productivity(inp, AS_OF, target=target)


# --- backlog ----------------------------------------------------------------------
@query("max_per_key")
def _max_per_key(inp):
    """Highest station sequence per shipment."""
    return max_per_key(inp.tracking, "shipment_id", "station_sequence")


@query("latest_per_key")
def _latest_per_key(inp):
    """Tracking rows at their shipment's highest sequence, ties kept."""
    return latest_per_key(inp.tracking, "shipment_id", "station_sequence")


@query("status_in")
def _status_in(inp):
    """Tracking rows with a backlog status."""
    return status_in(inp.tracking, "latest_spx_tracking_code", BACKLOG_CODES)


@query("prefix_any")
def _prefix_any(inp):
    """Tracking rows at a sorting centre bound for LM or XPT."""
    t = inp.tracking
    return t.filter(prefix_any("latest_spx_location", LOCATION_PREFIXES)).filter(
        prefix_any("final_spx_station_name", DESTINATION_PREFIXES)
    )


@query("trim_marker")
def _trim_marker(inp):
    """Hub code of each row's destination, marker trimmed."""
    return _with_regional(inp).select(
        "shipment_id", "station_sequence", "final_spx_station_id",
        trim_marker("superior_code_hub").alias("station_code"),
    )


@query("hub_lookup")
def _hub_lookup(inp):
    """Hub rows of each row's destination hub code."""
    dim = station_dim(inp.stations)
    rows = hub_lookup(_with_regional(inp), hub_rows(dim))
    return rows.select(
        "shipment_id", "station_sequence", "final_spx_station_id", "superior_code_hub",
        "hub_station_id", "hub_station_name", "hub_superior_station_code",
    )


@query("backlog_base")
def _backlog_base(inp):
    """The rows the backlog counts."""
    return backlog_rows(inp)


@query("status_pivot")
def _status_pivot(inp):
    """The eight status counts per sorting centre over the latest rows."""
    rows = latest_per_key(backlog_candidates(inp.tracking), "shipment_id", "station_sequence", within=inp.tracking)
    return status_pivot(rows, ["actual_station_id", "actual_station_name"], metric_conditions())


@query("backlog_report")
def _backlog_report(inp):
    """Q3: backlog report."""
    return backlog_report(inp, AS_OF_TS)

"""Shift productivity (Q1) and curve productivity (Q2).

Both jobs share one chain, and both directions (receive, dispatch) travel it
together in one frame keyed by ``direction``:

  shipment facts --(one scan)--> receive and dispatch events
     --> shipments per hour with their clock segments (the only aggregation
         over the facts) --> counts per set of segments
     --(join with the windows)--> hour profile
     --> window totals --> hourly shares [checkpointed]
  shares --> curves (one aggregation)
  shares --> window-days --> scan intervals --(one scan of the log)-->
     distinct operators
  shares + curves + operators --> window summary [checkpointed] --> report

So the facts and the scan log are each read once per job: what the report
uses twice (shares, and the summary whose two directions meet in it) is
computed once into the shared folder. No join is hinted; the planner and AQE
choose from measured sizes. Facts are shuffled once, by keys that hold the
shipment, so one very large station/day/hour group spreads over many tasks, and
never meet a window: counts do. Windows travel by number and get their texts
back with the shares. Everything after the profile is at (direction, station,
day, window[, hour]) grain.

The report keeps only the share columns it selects, deduplicated, before
joining: its rows are at window grain instead of hour grain. That is exact,
since the report is DISTINCT and selects no hour column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.rates import (
    duration_gap,
    hours,
    instant_text,
    rate_per_hour,
    rate_per_operator,
)
from hubflow.operators.backlog import station_dim
from hubflow.operators.classify import (
    DISPATCH_KEYS,
    RECEIPT_KEYS,
    classify_dispatches,
    classify_receipts,
    dispatch_rows,
    dispatches_inside,
    fact_events,
    receipt_rows,
    receipts_inside,
)
from hubflow.operators.curve import curve_stats
from hubflow.operators.profile import JOIN_KEYS, hour_profile, shares_of, window_shares
from hubflow.operators.segments import (
    DISPATCH,
    RECEIVE,
    SITE,
    WINDOW_TEXTS,
    segment_profile,
    window_dictionary,
)
from hubflow.operators.staffing import count_operators
from hubflow.operators.windows import window_table
from hubflow.sources.sinks import full_refresh, materialize, release
from hubflow.sources.testdata import Inputs

# fixed values: share thresholds of the two jobs (percent, 0-100 scale)
VOLUME_PCT = 5          # hours counted in the curve volume, both jobs
SHIFT_SPAN_PCT = 0.05   # hours spanning the curve, shift job (Q1)
CURVE_SPAN_PCT = 5      # hours spanning the curve, curve job (Q2)

GROUP_DAY = [*SITE, "group_no", "window_date"]    # windows of one label meet
WINDOW_DAY = [*GROUP_DAY, "window_no"]
POOL_DAY = [*SITE, "pool_no", "window_date"]      # operators are pooled
CURVE_COLUMNS = ["real_start", "real_end", "real_minutes", "curve_volume", "curve_start", "curve_end", "curve_minutes"]


# --- one direction at a time (used by the operator queries) -------------------
def receipt_share_frame(inputs: Inputs, windows: DataFrame, as_of=None, share_scale=None) -> DataFrame:
    """Hourly shares of inside receipts (outside receipts never reach a share)."""
    inside = receipts_inside(classify_receipts(receipt_rows(inputs.shipments, as_of), windows))
    profile = hour_profile(inside, "received_at", RECEIPT_KEYS)
    return window_shares(profile, RECEIPT_KEYS, JOIN_KEYS, share_scale)


def dispatch_share_frame(inputs: Inputs, windows: DataFrame, share_scale=None) -> DataFrame:
    inside = dispatches_inside(classify_dispatches(dispatch_rows(inputs.shipments), windows))
    profile = hour_profile(inside, "delivered_at", DISPATCH_KEYS)
    return window_shares(profile, DISPATCH_KEYS, JOIN_KEYS, share_scale)


# --- both directions together (used by the jobs) ------------------------------
def event_share_frame(inputs: Inputs, windows: DataFrame, as_of=None, share_scale=None) -> DataFrame:
    """Hourly shares of receipts and dispatches, keyed by ``direction``. Windows
    have their numbers and texts."""
    dictionary = window_dictionary(windows)
    profile = segment_profile(fact_events(inputs.shipments, as_of), dictionary)
    texts = dictionary.select(*SITE, "window_no", "pool_no", *WINDOW_TEXTS)
    return shares_of(profile, WINDOW_DAY, GROUP_DAY, share_scale).join(texts, [*SITE, "window_no"])


def event_operators(shares: DataFrame, scans: DataFrame) -> DataFrame:
    """Distinct operators per window-day, both directions from one pass over
    the scans. Receive: pooled per expanded label, same day and next day.
    Dispatch: per planned label, same day only."""
    wins = shares.select(*POOL_DAY, "planned").distinct()
    return count_operators(wins, "planned", POOL_DAY, F.col("direction") == RECEIVE, scans)


@dataclass(frozen=True)
class ShiftFrames:
    windows: DataFrame    # expanded planned windows
    shares: DataFrame     # hourly shares, both directions (checkpointed)
    summary: DataFrame    # window-days with totals, curves and operators (checkpointed)
    stations: DataFrame   # clean station dimension

    def release(self) -> None:
        """Delete the checkpoints once the report has been written."""
        for df in (self.shares, self.summary):
            release(df)


def shift_frames(
    inputs: Inputs,
    as_of=None,
    span_pct: float = SHIFT_SPAN_PCT,
    volume_pct: float = VOLUME_PCT,
    share_scale: int | None = None,
) -> ShiftFrames:
    """The frames behind both reports. Reliable checkpoints in the shared folder
    compute shares and summary once, survive the loss of an executor and keep
    the later plans small."""
    windows = window_table(inputs.planning)
    shares = materialize(event_share_frame(inputs, windows, as_of, share_scale))
    curves = curve_stats(
        shares, WINDOW_DAY, volume_pct, span_pct,
        shift_label="planned", shift_if=F.col("direction") == DISPATCH,
    )
    summary = materialize(window_summary(shares, curves, event_operators(shares, inputs.scans)))
    return ShiftFrames(windows, shares, summary, station_dim(inputs.stations))


def window_summary(shares: DataFrame, curves: DataFrame, operators: DataFrame) -> DataFrame:
    """One row per (window-day, matched totals row, matched curve row), both
    directions: total, curve statistics (matched on station, day and expanded
    label, so windows sharing that label see each other's curves) and
    operators. The first join needs no exchange: both sides come from the
    shares, which are partitioned by its keys."""
    base = shares.select(*WINDOW_DAY, "pool_no", *WINDOW_TEXTS, "window_total").distinct()
    return (
        base.join(curves.select(*GROUP_DAY, *CURVE_COLUMNS), GROUP_DAY, "left")
        .join(operators, POOL_DAY, "left")
        .drop("group_no", "window_no", "pool_no")
    )


def _joined(f: ShiftFrames) -> DataFrame:
    """Receive rows, their planned dispatch windows, the dispatch rows of the
    same day and the station, before DISTINCT."""
    summary = f.summary
    p = summary.filter((F.col("direction") == RECEIVE) & F.col("planned").isNotNull()).alias("p")
    d = summary.filter(F.col("direction") == DISPATCH).alias("d")
    je = f.windows.select("station_id", "receive_planned", "dispatch_planned").alias("je")
    sc = f.stations.alias("sc")
    return (
        p.join(
            je,
            (F.col("p.station_id") == F.col("je.station_id")) & (F.col("p.planned") == F.col("je.receive_planned")),
            "left",
        )
        .join(
            d,
            (F.col("je.station_id") == F.col("d.station_id"))
            & (F.col("p.window_date") == F.col("d.window_date"))
            & (F.col("je.dispatch_planned") == F.col("d.planned")),
            "left",
        )
        .join(sc, F.col("p.station_id") == F.col("sc.station_id").cast("string"), "left")
    )


# The output names below are fixed values: readers of the reports use them.
def _receive_columns():
    return [
        F.col("p.station_id").alias("station_id"),
        F.col("sc.lm_regional").alias("lm_regional"),
        F.col("sc.sub_regional").alias("sub_regional"),
        F.col("sc.station_name").alias("station_name"),
        F.col("sc.code_name").alias("code_name"),
        F.col("p.window_date").alias("data_base_janela"),
        F.col("p.planned").alias("janela_programada_received"),
        F.col("p.expanded").alias("janela_expandida_received"),
        F.col("p.window_total").alias("total_da_janela_received"),
        F.col("p.curve_volume").alias("total_da_curva_received"),
        instant_text("p.real_start").alias("datetime_inicio_real_received"),
        instant_text("p.real_end").alias("datetime_fim_real_received"),
        F.col("p.real_minutes").alias("total_minutos_real_received"),
        hours("p.real_minutes").alias("duracao_horas_received"),
        instant_text("p.curve_start").alias("datetime_inicio_curva_received"),
        instant_text("p.curve_end").alias("datetime_fim_curva_received"),
        F.col("p.curve_minutes").alias("duracao_minutos_curva_received"),
        hours("p.curve_minutes").alias("duracao_horas_curva_received"),
        duration_gap("p.curve_minutes", "p.real_minutes").alias("diferenca_duracao_curva_received"),
    ]


def _dispatch_columns():
    return [
        F.col("d.planned").alias("janela_programada_dispatch"),
        F.col("d.expanded").alias("janela_expandida_dispatch"),
        F.col("d.window_total").alias("total_da_janela_dispatch"),
        F.col("d.curve_volume").alias("total_da_curva_dispatch"),
        instant_text("d.real_start").alias("datetime_inicio_real_dispatch"),
        instant_text("d.real_end").alias("datetime_fim_real_dispatch"),
        F.col("d.real_minutes").alias("total_minutos_real_dispatch"),
        hours("d.real_minutes").alias("duracao_horas_dispatch"),
        instant_text("d.curve_start").alias("datetime_inicio_curva_dispatch"),
        instant_text("d.curve_end").alias("datetime_fim_curva_dispatch"),
        F.col("d.curve_minutes").alias("duracao_curva_dispatch"),
        hours("d.curve_minutes").alias("duracao_horas_curva_dispatch"),
        duration_gap("d.curve_minutes", "d.real_minutes").alias("diferenca_duracao_curva_dispatch"),
    ]


def _dispatch_operators():
    """Operators in the dispatch window; 0 also when no dispatch row matched."""
    return F.coalesce(F.col("d.operators"), F.lit(0))


def shift_report(f: ShiftFrames) -> DataFrame:
    """Q1 report columns (39), deduplicated."""
    cols = (
        _receive_columns()
        + [
            rate_per_hour("p.window_total", "p.real_minutes").alias("produtividade_received"),
            F.col("p.operators").alias("total_operadores_received"),
            rate_per_operator("p.window_total", "p.operators").alias("produtividade_por_operador_received"),
        ]
        + _dispatch_columns()
        + [
            rate_per_hour("d.window_total", "d.real_minutes").alias("produtividade_dispatch"),
            _dispatch_operators().alias("operadores_dispatch"),
            rate_per_operator("d.window_total", _dispatch_operators()).alias("produtividade_por_operador_dispatch"),
            F.col("p.real_minutes").alias("total_minutos_real_received_debug"),
        ]
    )
    return _joined(f).select(*cols).distinct()


def curve_report(f: ShiftFrames) -> DataFrame:
    """Q2 report columns (38), deduplicated and ordered."""
    cols = (
        _receive_columns()
        + [
            rate_per_hour("p.curve_volume", "p.curve_minutes").alias("produtividade_curva_received"),
            rate_per_hour("p.window_total", "p.real_minutes").alias("produtividade_real_received"),
            F.col("p.operators").alias("total_operadores_received"),
        ]
        + _dispatch_columns()
        + [
            rate_per_hour("d.curve_volume", "d.curve_minutes").alias("produtividade_curva_dispatch"),
            rate_per_hour("d.window_total", "d.real_minutes").alias("produtividade_real_dispatch"),
            _dispatch_operators().alias("operadores_dispatch"),
        ]
    )
    return (
        _joined(f)
        .select(*cols)
        .distinct()
        .orderBy("station_id", "data_base_janela", "janela_programada_received")
    )


def shift_productivity(inputs: Inputs, as_of=None, target: str | None = None, **options) -> DataFrame:
    """Q1: shift productivity per station, day and window (curve span above
    0.05 %, rates per operator).

    With ``target`` (a table name or folder), the report replaces the target's
    contents (full refresh), the materialised intermediate frames are released,
    and the stored rows are returned."""
    options.setdefault("span_pct", SHIFT_SPAN_PCT)
    frames = shift_frames(inputs, as_of, **options)
    report = shift_report(frames)
    if target is None:
        return report
    stored = full_refresh(report, target)
    frames.release()
    return stored


def curve_productivity(inputs: Inputs, as_of=None, **options) -> DataFrame:
    """Q2: productivity over the curve (hours above 5 %) and over the real
    span, ordered by station, day and planned window."""
    options.setdefault("span_pct", CURVE_SPAN_PCT)
    return curve_report(shift_frames(inputs, as_of, **options))

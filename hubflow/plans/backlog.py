"""Q3: backlog of parcels at sorting centres, by station and status.

Plan: the tracking log is filtered (status, location, destination), meets
the latest local BR snapshot, keeps the rows at the shipment's highest sequence
(MAX over *all* of the shipment's rows, then a left-semi join), looks up the
station and hub rows and is counted per key in one aggregation. The log is read
twice: narrowly for the MAX, and filtered for the candidates. Small lookup
tables are broadcast by the planner, by their measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.clock import load_stamp
from hubflow.functions.codes import prefix_any, trim_marker
from hubflow.operators.backlog import hub_lookup, hub_rows, latest_per_key, latest_snapshot, station_dim, status_pivot
from hubflow.operators.filters import slice_dim, status_in
from hubflow.sources.testdata import Inputs

# --- fixed values of the backlog report ------------------------------------
BACKLOG_CODES = [8, 9, 33, 15, 630, 36]
LOCATION_PREFIXES = ["SoC"]
DESTINATION_PREFIXES = ["LM", "XPT"]
SNAPSHOT_SLICE = {"tz_type": "local", "grass_region": "BR"}
LOAD_LAG_HOURS = 11
# metric: (status codes, required prefix of next_point or None)
BACKLOG_METRICS = {
    "1st_SOC_Received": ([8], None),
    "1st_SOC_Packing": ([9], None),
    "1st_SOC_Packed": ([33], None),
    "SOC_Staging": ([630], None),
    "SOC_LHTransporting": ([15], None),
    "SoC_to_SoC": ([15, 36], "SoC"),
    "SoC_to_LM_transporting": ([15], "LM"),
    "SoC_to_LM_transported": ([36], "LM"),
}
# ---------------------------------------------------------------------------


def metric_conditions() -> dict:
    code = F.col("latest_spx_tracking_code")
    out = {}
    for name, (codes, prefix) in BACKLOG_METRICS.items():
        cond = code.isin(codes)
        if prefix is not None:
            cond = cond & F.col("next_point").startswith(prefix)
        out[name] = cond
    return out


def backlog_candidates(tracking: DataFrame) -> DataFrame:
    """Tracking rows with a backlog status, at a sorting centre, bound for a
    last-mile or XPT station."""
    rows = status_in(tracking, "latest_spx_tracking_code", BACKLOG_CODES)
    return rows.filter(prefix_any("latest_spx_location", LOCATION_PREFIXES)).filter(
        prefix_any("final_spx_station_name", DESTINATION_PREFIXES)
    )


def backlog_rows(inputs: Inputs) -> DataFrame:
    """The rows that the backlog counts, before grouping."""
    dim = station_dim(inputs.stations)
    regional = dim.select(F.col("station_id").alias("r_station_id"), "superior_code_hub")
    snap = slice_dim(latest_snapshot(inputs.snapshot), **SNAPSHOT_SLICE).select(
        F.col("station_name").alias("snap_name")
    )

    rows = backlog_candidates(inputs.tracking)
    # inner: the WHERE on the snapshot columns drops unmatched rows; several
    # snapshot rows with one name each keep their copy of the row
    rows = rows.join(snap, rows["next_point"] == snap["snap_name"]).drop("snap_name")
    rows = latest_per_key(rows, "shipment_id", "station_sequence", within=inputs.tracking)
    # a malformed id matches no station; it doesn't end the job
    rows = rows.join(
        regional, rows["final_spx_station_id"].try_cast("bigint") == regional["r_station_id"], "left"
    ).drop("r_station_id")
    return hub_lookup(rows, hub_rows(dim))


def backlog_report(inputs: Inputs, as_of_ts=None) -> DataFrame:
    """Q3: per sorting centre, hub code and hub station: eight overlapping
    status counts, plus the load stamp (now minus 11 hours)."""
    keys = [
        F.col("actual_station_id").alias("SoCId"),
        F.col("actual_station_name").alias("SoCName"),
        trim_marker("superior_code_hub").alias("station_code"),
        F.col("hub_station_id").alias("station_id"),
        F.col("hub_station_name").alias("station_name"),
    ]
    counts = status_pivot(backlog_rows(inputs), keys, metric_conditions())
    return counts.withColumn("last_update_time", load_stamp(as_of_ts, LOAD_LAG_HOURS))

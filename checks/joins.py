"""What the joins of ``operators_per_window`` put out, from Spark's event log:
one station-day with many overlapping windows and many scans.

    python -m checks.joins
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile

from checks.measure import _events

WINDOWS, SCANS, OPERATORS = 90, 30_000, 4


def _nodes(plan: dict) -> list[tuple[str, int]]:
    own = [(plan["nodeName"], m["accumulatorId"]) for m in plan["metrics"] if m["name"] == "number of output rows"]
    return own + [x for child in plan["children"] for x in _nodes(child)]


def join_rows(log_dir: str) -> list[int]:
    """Rows put out by each join that ran."""
    joins, rows = set(), {}
    for e in _events(log_dir):
        if "sparkPlanInfo" in e:
            joins |= {i for name, i in _nodes(e["sparkPlanInfo"]) if "Join" in name}
        elif e["Event"] == "SparkListenerTaskEnd":
            for a in e["Task Info"].get("Accumulables", []):
                if str(a.get("Update", "")).isdigit():
                    rows[a["ID"]] = rows.get(a["ID"], 0) + int(a["Update"])
    return [rows[i] for i in joins if i in rows]


def main() -> dict[str, int]:
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from pyspark.sql import functions as F

    from hubflow.operators.staffing import hour_cuts, operators_per_window, window_intervals
    from hubflow.session import local_session

    spark = local_session(4, "hubflow-joins", **{
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    })
    day = dt.datetime(2024, 1, 10)
    windows = [("0", day.date(), f"L{i}", f"{i % 10:02d}:00 às {12 + i // 10:02d}:00") for i in range(WINDOWS)]
    shares = spark.createDataFrame(windows, "station_id string, window_date date, window_label string, receive_planned string")
    scans = spark.range(SCANS).select(
        F.lit(0).cast("long").alias("station_id"),
        (F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 80_000)).alias("datetime"),
        F.concat(F.lit("op"), F.col("id") % OPERATORS).alias("operator_name"),
        F.lit(1).alias("bin_received_attempt"),
    )
    operators_per_window(shares, scans).collect()
    intervals = window_intervals(shares, "receive_planned", True)
    segments = 24 + hour_cuts(intervals).select(F.sum(F.size("cuts"))).first()[0]
    spark.stop()
    hours = [[int(x[:2]) * 3600 for x in w[3].split(" às ")] for w in windows]
    pairs = sum(lo <= i % 80_000 <= hi for i in range(SCANS) for lo, hi in hours)
    rows = join_rows(log_dir)
    return {"scans": SCANS, "most": max(rows), "segments": segments, "operators": OPERATORS, "pairs": pairs}


if __name__ == "__main__":
    print(json.dumps(main()))

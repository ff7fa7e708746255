"""
shuffle bytes written and rows out, from Spark's event log in a scratch
folder.

    python -m checks.measure /root/testdata/sf0.1 [key ...]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

DEFAULT = ["shift_report", "curve_report", "backlog_report", "operators_per_window", "latest_per_key", "receipt_profile"]


def _events(log_dir):
    """All JSON events of the (uncompressed) event logs under ``log_dir``."""
    out = []
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isfile(path):
            with open(path) as fh:
                out += [json.loads(line) for line in fh if line.startswith("{")]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    keys = argv[2:] or DEFAULT
    sys.path.insert(0, ".")
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from hubflow.plans.queries import QUERIES
    from hubflow.session import local_session

    spark = local_session(8, "hubflow-measure", **{
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.driver.memory": "8g",
    })
    sc = spark.sparkContext
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    for key in keys:
        QUERIES[key](spark, warm).write.format("noop").mode("overwrite").save()
    rows, walls, groups = {}, {}, {}
    for key in keys:
        for run in range(3):
            spark.catalog.clearCache()
            group = f"{key}#{run}"
            sc.setJobGroup(group, group)
            t0 = time.perf_counter()
            df = QUERIES[key](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            walls.setdefault(key, []).append(time.perf_counter() - t0)
            groups[group] = set(sc.statusTracker().getJobIdsForGroup(group))
        sc.setJobGroup("count", "count")
        rows[key] = QUERIES[key](spark, sf_dir).count()
    spark.stop()
    ev = _events(log_dir)
    stage_job = {}
    for e in ev:
        if e["Event"] == "SparkListenerJobStart":
            for sid in e["Stage IDs"]:
                stage_job.setdefault(sid, e["Job ID"])
    shuffle = {}
    for e in ev:
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            job = stage_job.get(e["Stage ID"])
            w = e["Task Metrics"].get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            for group, jobs in groups.items():
                if job in jobs:
                    shuffle[group] = shuffle.get(group, 0) + w
    print("| query | median wall s | runs | shuffle bytes written | rows out |")
    print("| --- | --- | --- | --- | --- |")
    for key in keys:
        sb = statistics.median(shuffle.get(f"{key}#{r}", 0) for r in range(3))
        print(f"| {key} | {statistics.median(walls[key]):.2f} | {', '.join(f'{w:.2f}' for w in walls[key])} | {int(sb):,} | {rows[key]:,} |")


if __name__ == "__main__":
    main(sys.argv)

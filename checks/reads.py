"""How often each query reads the facts: records read by all jobs between its
start and its end, from Spark's event log, by the rows of ``events``. Joins are
shuffled (no broadcasts), as with inputs beyond the broadcast threshold.

    python -m checks.reads /root/testdata/sf0.001 key ...
"""

from __future__ import annotations

import json
import sys
import tempfile
import time

from checks.measure import _events


def reads(sf_dir: str, keys: list[str]) -> dict[str, float]:
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from hubflow.plans.queries import QUERIES
    from hubflow.session import local_session

    spark = local_session(4, "hubflow-reads", **{
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    })
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spans = {}
    for key in keys:
        start = time.time()
        QUERIES[key](spark, sf_dir).collect()
        spans[key] = (start * 1000, time.time() * 1000)
    spark.stop()
    out = dict.fromkeys(keys, 0.0)
    for e in _events(log_dir):
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            at = e["Task Info"]["Launch Time"]
            for key, (start, end) in spans.items():
                if start <= at <= end:
                    out[key] += e["Task Metrics"]["Input Metrics"]["Records Read"] / rows
    return out


if __name__ == "__main__":
    print(json.dumps(reads(sys.argv[1], sys.argv[2:])))

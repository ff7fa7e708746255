"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected to the driver) after the cache is cleared.
Best of $BENCH_REPEAT runs per query. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "shift_report",
    "curve_report",
    "backlog_report",
    "operators_per_window",
    "latest_per_key",
    "receipt_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from hubflow.plans.queries import QUERIES
    from hubflow.session import local_session

    spark = local_session(cpus, "hubflow-bench", **{"spark.driver.memory": "8g"})
    # JVM warm-up (JIT, codegen) on the smallest scale factor, if present;
    # nothing is cached across runs: the cache is cleared before each run
    warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warmup = os.path.isdir(warm_dir) and warm_dir != sf_dir
    if warmup:
        for name in HEADLINE:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    spark.range(1000).selectExpr("sum(id)").collect()

    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total_wall",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "runs": f"best of {repeat}",
                "warmup": "sf0.001" if warmup else "none",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Write PLANS.md: for each headline query, the scans (read schema, pushed
filters), exchanges (partitioning keys) and joins (strategy, type) of its
final adaptive plan at the given scale factor.

    python -m checks.plans /root/testdata/sf0.1 > PLANS.md
"""

from __future__ import annotations

import re
import sys

HEADLINE = ["shift_report", "curve_report", "backlog_report", "operators_per_window", "latest_per_key", "receipt_profile"]


def _clean(line: str) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r", \[plan_id=\d+\]", "", line)
    return line.strip(" :+-*()0123456789").strip()


def summarize(plan: str) -> dict[str, list[str]]:
    out = {"scans": [], "exchanges": [], "joins": [], "other": []}
    for raw in plan.splitlines():
        line = _clean(raw)
        if line.startswith("FileScan"):
            table = re.search(r"Location: .*?\[file:[^\]]*/([\w.]+)\]", line)
            schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
            out["scans"].append(
                f"{table.group(1) if table else '?'}: read {schema.group(1) if schema else '?'}, "
                f"pushed {pushed.group(1) if pushed else '[]'}"
            )
        elif line.startswith("Exchange"):
            out["exchanges"].append(line.split(", ENSURE_REQUIREMENTS")[0].split(", REPARTITION")[0][:160])
        elif "BroadcastExchange" in line:
            out["exchanges"].append("BroadcastExchange")
        elif re.match(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", line):
            parts = line.split(", ")
            out["joins"].append(", ".join(p for p in parts if p in (
                "Inner", "LeftOuter", "LeftSemi", "LeftAnti", "BuildRight", "BuildLeft")) and
                line.split(" [")[0] + " " + re.sub(r"\s+", " ", line.split("]")[0].split("[", 1)[-1]) + " : " +
                ", ".join(p for p in parts if p in ("Inner", "LeftOuter", "LeftSemi", "LeftAnti", "BuildRight", "BuildLeft")))
        elif line.startswith(("InMemoryTableScan", "ReusedExchange", "AQEShuffleRead")):
            out["other"].append(line.split(" [")[0])
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    sys.path.insert(0, ".")
    from hubflow.plans.queries import QUERIES
    from hubflow.session import local_session

    spark = local_session(8, "hubflow-plans")
    print("# PLANS\n")
    print(f"Final adaptive plans at `{sf_dir}`, `local[8]`, generated by `python -m checks.plans`.")
    print("Plans start at the checkpoints of shares and summary in the two reports; the facts and the scan log are read below them (see `checks/reads.py`).\n")
    print(
        "Reading notes: the shift and curve jobs scan `events` (the shipment facts) once for both\n"
        "directions; dispatches have no date limit in the source job (T12), so that scan cannot push\n"
        "the receive date range and reads every row once (the per-direction operator queries, e.g.\n"
        "`receipt_profile`, do push it). The exchanges keyed by (..., shipment_id) and\n"
        "(..., operator_name) are the first halves of COUNT(DISTINCT), the skew-safe plan.\n"
    )
    for key in HEADLINE:
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"## {key}\n")
        for name in ("scans", "joins", "exchanges"):
            seen = []
            for item in s[name]:
                if item and item not in seen:
                    seen.append(item)
            print(f"**{name}** ({len(s[name])} in plan, {len(seen)} distinct)\n")
            for item in seen:
                print(f"* `{item}`")
            print()
        bad = [n for n in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython") if n in plan]
        print(f"nested-loop / cartesian / Python nodes: {', '.join(bad) if bad else 'none'}\n")


if __name__ == "__main__":
    main(sys.argv)

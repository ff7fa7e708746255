"""Plan checks: no nested-loop or cartesian joins, no Python UDFs, filters
and column pruning reach the parquet scan, and invariants of the data."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hubflow.operators.classify import classify_receipts, receipt_rows, receipts_inside, receipts_outside
from hubflow.operators.windows import window_table
from hubflow.sources.testdata import AS_OF
from hubflow.plans.queries import QUERIES
from tests.conftest import ROOT, SF_SMALL
from tests.test_skew import conf

BAD_NODES = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final(df):
    """Rows and the final adaptive plan of the run that made them."""
    rows = df.collect()
    plan = _plan(df)
    return rows, plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_nested_loops_or_python(spark, key):
    _, plan = _final(QUERIES[key](spark, SF_SMALL))
    for node in BAD_NODES:
        assert node not in plan, f"{key}: {node}"


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.mark.parametrize("key", ["shift_report", "curve_report", "backlog_report", "operators_per_window", "receipt_profile"])
def test_shuffled_and_broadcast_joins_agree(spark, key):
    broadcast, plan = _final(QUERIES[key](spark, SF_SMALL))
    with conf(spark, NO_BROADCAST):
        shuffled, other = _final(QUERIES[key](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "BroadcastHashJoin" not in other and "SortMergeJoin" in other
    assert sorted(map(repr, broadcast)) == sorted(map(repr, shuffled)) and broadcast


#: Most reads of ``events`` by a query. Facts and scan log both come from it, so
#: the reports may read it twice; the outside path reads the facts only.
READS = {"shift_report": 2, "curve_report": 2, "receipts_outside": 2, "all_receipts": 3, "receipt_profile": 3}


def test_facts_and_scans_are_read_no_more_than_needed():
    """A session of its own, as the event log is set when a session starts. The
    windows and dimensions are a few rows of the same count."""
    run = subprocess.run(
        [sys.executable, "-m", "checks.reads", SF_SMALL, *READS], capture_output=True, text=True, cwd=ROOT, timeout=600
    )
    got = json.loads(run.stdout.splitlines()[-1])
    for key, most in READS.items():
        assert 0.9 < got[key] < most + 0.5, got


def test_curve_report_is_ordered(spark):
    rows = [(r.station_id, r.data_base_janela, r.janela_programada_received) for r in QUERIES["curve_report"](spark, SF_SMALL).collect()]
    assert rows == sorted(rows) and len(set(rows)) > 5


def test_filters_and_columns_reach_the_scan(spark, inputs):
    df = receipt_rows(inputs.shipments, AS_OF)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_distinct_count_shuffles_on_keys_and_id_first(spark, inputs):
    """The profile's COUNT(DISTINCT) must shuffle on (keys, shipment id) before
    the keys alone, so one hot group is spread over tasks."""
    _, plan = _final(entry.queries()["receipt_profile"](spark, SF_SMALL))
    keys = [part.split(")")[0] for part in plan.split("Exchange hashpartitioning(")[1:]]
    with_id = [k for k in keys if "shipment_id" in k and "station_id" in k]
    without_id = [k for k in keys if "shipment_id" not in k and "station_id" in k and "window_date" in k]
    assert with_id and without_id


def test_inside_and_outside_cover_every_receipt(spark, inputs):
    rows = receipt_rows(inputs.shipments, AS_OF)
    inside = receipts_inside(classify_receipts(rows, window_table(inputs.planning)))
    outside = receipts_outside(rows, inside)
    ids = rows.select("shipment_id").distinct()
    covered = inside.select("shipment_id").union(outside.select("shipment_id")).distinct()
    assert ids.exceptAll(covered).count() == 0 and covered.exceptAll(ids).count() == 0
    assert inside.select("shipment_id").intersect(outside.select("shipment_id")).count() == 0


def test_shares_sum_to_100_without_collisions(spark):
    shares = entry.queries()["receipt_shares"](spark, SF_SMALL)
    # station 2 has two planned windows with one expanded label (T2); elsewhere sums are 100
    sums = shares.filter(F.col("station_id") != "2").groupBy(
        "station_id", "window_date", "receive_planned"
    ).agg(F.sum("share").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 100) > 0.05 * 24).count() == 0


def test_curve_is_inside_the_real_span(spark):
    """The curve hours are a subset of the window's hours: its volume and (on
    the receive side, without the overnight shift) its span cannot exceed the
    window's."""
    for key in ("curve_stats", "curve_stats_low"):
        c = entry.queries()[key](spark, SF_SMALL)
        assert c.filter(F.col("curve_volume") > F.col("volume")).count() == 0
        assert c.filter(F.col("curve_minutes") > F.col("real_minutes")).count() == 0
        assert c.filter(F.col("curve_start") < F.col("real_start")).count() == 0

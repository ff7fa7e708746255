"""One key holding a third of all rows: the joins that shuffle on a key that
can be hot are ones AQE can split (left-semi for the latest rows, left-anti
for outside receipts). Thresholds are lowered so a small fixture counts as
skewed; results are checked against brute force."""

import contextlib
import datetime as dt

import pytest
from pyspark.sql import functions as F

from hubflow.operators.backlog import latest_per_key
from hubflow.operators.classify import receipts_outside
from hubflow.operators.joins import anti_join

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _final_plan(df):
    rows = df.collect()  # runs this DataFrame's own plan, so its final plan is readable
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot_log(spark):
    # shipment 1 holds a third of the rows, all tied at its highest sequence
    return spark.range(90000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") + 10).alias("shipment_id"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 7).cast("int").alias("station_sequence"),
        F.col("id").alias("row_id"),
    )


def test_latest_rows_split_the_hot_key(spark, hot_log):
    with conf(spark, SKEW_CONF):
        rows, plan = _final_plan(latest_per_key(hot_log, "shipment_id", "station_sequence"))
    assert "SortMergeJoin(skew=true)" in plan
    assert len(rows) == 90000  # every row is the latest of its shipment (ties kept)


def test_outside_receipts_split_the_hot_id_and_spread_nulls(spark):
    shipment = (
        F.when(F.col("id") % 3 == 0, F.lit(7))            # hot id, outside
        .when(F.col("id") % 3 == 1, F.lit(8))             # hot id, inside
        .when(F.col("id") % 2 == 0, F.lit(None))          # NULL ids: never match
        .otherwise(F.col("id") + 10)
    )
    receipts = spark.range(90000).select(
        F.lit("1").alias("station_id"),
        shipment.cast("long").alias("shipment_id"),
        F.lit(dt.date(2024, 1, 10)).alias("received_date"),
        F.lit(900).alias("received_hhmm"),
        (F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("received_at"),
    )
    inside = receipts.filter((F.col("shipment_id") % 2 == 0) & F.col("shipment_id").isNotNull()).select("shipment_id")
    with conf(spark, SKEW_CONF):
        rows, plan = _final_plan(receipts_outside(receipts, inside))
    assert "SortMergeJoin(skew=true)" in plan
    got = {}
    for r in rows:
        key = r.shipment_id if r.shipment_id in (None, 7, 8) else "other"
        got[key] = got.get(key, 0) + 1
    assert got[7] == 30000 and got[None] == 15000 and 8 not in got
    assert got["other"] == sum(1 for i in range(90000) if i % 3 == 2 and i % 2 and (i + 10) % 2)


def test_anti_join_keeps_nulls_and_duplicates(spark):
    left = spark.createDataFrame([(None, 1), (None, 1), (0, 2), (1, 3), (1, 3), (2, 4)], "k long, v long")
    right = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    got = anti_join(left, right, "k")
    assert got.columns == ["k", "v"]
    assert sorted(((r.k if r.k is not None else -1), r.v) for r in got.collect()) == [(-1, 1), (-1, 1), (0, 2), (2, 4)]
    assert anti_join(left, right.limit(0), "k").count() == 6

"""The operators against brute force in plain Python on seeded random rows, and
the one-pass (both directions) frames against the per-direction ones."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hubflow.operators.backlog import latest_per_key
from hubflow.operators.staffing import operators_in_dispatch, operators_per_window
from hubflow.sources.testdata import AS_OF

BASE = dt.datetime(2024, 1, 10)


def _rows(seed):
    rnd = random.Random(seed)
    labels = ["22:00 às 03:15", "06:00 às 12:00", "23:30 às 00:10", "00006 às 00012", "13:15 às 13:45", "20:00 às 02:00"]
    shares = [
        (str(rnd.randrange(3)), (BASE + dt.timedelta(days=rnd.randrange(4))).date(), f"L{rnd.randrange(3)}", rnd.choice(labels))
        for _ in range(60)
    ]
    scans = [
        (
            rnd.randrange(3),
            BASE + dt.timedelta(minutes=rnd.randrange(6 * 24 * 60)),
            None if rnd.random() < 0.1 else f"op{rnd.randrange(25)}",
            1 if rnd.random() < 0.9 else 0,
        )
        for _ in range(400)
    ]
    return shares, scans


def _frames(spark, shares, scans):
    s = spark.createDataFrame(shares, "station_id string, window_date date, window_label string, receive_planned string")
    sc = spark.createDataFrame(scans, "station_id long, datetime timestamp_ntz, operator_name string, bin_received_attempt int")
    return s.withColumn("dispatch_planned", F.col("receive_planned")), sc


def _operators(window, scans, next_day):
    """Names that scan at the window's station while it is open."""
    station, day, _, label = window
    if label.startswith("0000"):
        return set()
    start, end = (dt.time(int(x[:2]), int(x[3:])) for x in label.split(" às "))
    names = set()
    for at_station, at, name, attempt in scans:
        if str(at_station) != station or attempt != 1 or name is None:
            continue
        if at.date() == day and start <= at.time() <= end:
            names.add(name)
        if next_day and start.hour > end.hour and at.date() == day + dt.timedelta(days=1) and at.time() <= end:
            names.add(name)
    return names


def test_operators_per_window_against_brute_force(spark):
    shares, scans = _rows(7)
    pooled = {}
    for w in shares:
        pooled.setdefault(w[:3], set()).update(_operators(w, scans, True))
    got = operators_per_window(*_frames(spark, shares, scans)).collect()
    assert {tuple(r)[:3]: r.operators for r in got} == {k: len(v) for k, v in pooled.items() if v}
    assert len(got) > 5


def test_operators_in_dispatch_against_brute_force(spark):
    shares, scans = _rows(11)
    want = {(w[0], w[1], w[3]): len(_operators(w, scans, False)) for w in shares}
    got = operators_in_dispatch(*_frames(spark, shares, scans)).collect()
    assert {(r.station_id, r.window_date, r.dispatch_planned): r.operators for r in got} == want


def test_latest_per_key_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 3, 4]), rnd.randrange(4), i) for i in range(300)]
    top = {}
    for key, order, _ in rows:
        top[key] = max(order, top.get(key, order))
    log = spark.createDataFrame(rows, "shipment_id long, station_sequence int, i int")
    got = latest_per_key(log, "shipment_id", "station_sequence").select("i")
    assert sorted(r.i for r in got.collect()) == [i for k, o, i in rows if k is not None and o == top[k]]


def test_one_pass_frames_match_per_direction(spark, inputs):
    from hubflow.operators.windows import window_table
    from hubflow.plans.shift import dispatch_share_frame, event_share_frame, receipt_share_frame

    win = window_table(inputs.planning)
    both = event_share_frame(inputs, win, AS_OF)
    cols = ["station_id", "window_date", "window_label", "planned", "expanded", "hour", "first_at", "shipments", "window_total", "share"]
    r = receipt_share_frame(inputs, win, AS_OF).withColumnRenamed("receive_planned", "planned").withColumnRenamed("receive_expanded", "expanded")
    d = dispatch_share_frame(inputs, win).withColumnRenamed("dispatch_planned", "planned").withColumnRenamed("dispatch_expanded", "expanded")
    for direction, single in (("receive", r), ("dispatch", d)):
        one = both.filter(F.col("direction") == direction).select(*cols)
        assert one.exceptAll(single.select(*cols)).count() == 0
        assert single.select(*cols).exceptAll(one).count() == 0

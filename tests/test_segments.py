"""Clock segments and elementary intervals against plain Python on seeded
random rows, and what their joins put out."""

import datetime as dt
import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from hubflow.operators.segments import SALTS, hour_cells, placed_events, segment_counts, segment_profile, window_dictionary
from hubflow.operators.staffing import hour_cuts, operators_per_window, scan_rows, scan_segments, window_intervals
from hubflow.operators.windows import window_table
from hubflow.sources.testdata import PLANNING_COLUMNS
from tests.conftest import ROOT

BASE = dt.datetime(2024, 1, 10)
#: Windows that pass midnight, two that begin and end in one hour (planned, and
#: once widened), equal expanded labels, shared dispatch windows, odd texts.
PLANNING = [
    ("0", "06:00:00", "12:00:00", "13:00:00", "18:00:00"),
    ("0", "06:00:00", "12:00:00", "10:40:00", "10:20:00"),
    ("0", "00:10:00", "22:20:00", "13:00:00", "18:00:00"),
    ("0", "00:40:00", "22:20:00", "23:59:00", "23:58:00"),
    ("0", "22:00:00", "04:00:00", "05:00:00", "05:00:00"),
    ("1", "9:30:00", "15:45:00", "22:00:00", "03:15:00"),
    ("1", "11:30:00", "09:45:00", "10:10:00", "10:50:00"),
    ("1", "06:75:00", "12:00:00", "13:61:00", "18:00:00"),
    ("1", "ab:cd:00", "12:00:00", "13:00:00", "18:00:00"),
    ("1", "06:00", "12:00", "13:00", "18:00"),
]


def events(seed, n=900):
    draw = random.Random(seed)
    return [
        (
            draw.choice(["receive", "dispatch"]),
            str(draw.randrange(3)),
            draw.choice([None, *range(60)]),
            BASE + dt.timedelta(minutes=draw.choice([0, 600, 1380]) + draw.randrange(60) + 1440 * draw.randrange(3), seconds=draw.randrange(60))
            if draw.random() < 0.7
            else BASE + dt.timedelta(seconds=draw.randrange(4 * 86400)),
        )
        for _ in range(n)
    ] + [("receive", "0", None, BASE.replace(day=20, hour=7))]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "direction string, station_id string, shipment_id long, event_at timestamp_ntz")
    return df.withColumn("event_hhmm", (F.hour("event_at") * 100 + F.minute("event_at")).cast("int"))


def plain(windows, rows):
    """Every event with every window of its station and direction."""
    groups = {}
    for w in windows:
        for direction, lo, hi, planned, expanded in (
            ("receive", w.receive_open, w.receive_close, w.receive_planned, w.receive_expanded),
            ("dispatch", w.dispatch_start, w.dispatch_end, w.dispatch_planned, w.dispatch_expanded),
        ):
            if lo is None or hi is None or w.receive_expanded is None:
                continue
            for d, station, ship, at in rows:
                hm = at.hour * 100 + at.minute
                if d != direction or station != w.station_id:
                    continue
                if not ((hm >= lo or hm <= hi) if lo > hi else lo <= hm <= hi):
                    continue
                date = at.date() - dt.timedelta(days=int(lo > hi and hm < lo))
                key = (direction, station, date, w.receive_expanded, planned, expanded, at.hour)
                groups.setdefault(key, []).append((ship, at))
    return {k: (min(at for _, at in v), len({s for s, _ in v} - {None})) for k, v in groups.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_profile_against_every_event_and_window(spark, seed):
    windows = window_table(spark.createDataFrame(PLANNING, ", ".join(f"{c} string" for c in PLANNING_COLUMNS)))
    rows = events(seed)
    dictionary = window_dictionary(windows)
    profile = segment_profile(frame(spark, rows), dictionary).join(dictionary, ["direction", "station_id", "window_no", "group_no"])
    got = {
        (r.direction, r.station_id, r.window_date, r.window_label, r.planned, r.expanded, r.hour): (r.first_at, r.shipments)
        for r in profile.collect()
    }
    want = plain(windows.collect(), rows)
    assert got == want
    assert any(k[4] == "10:40 às 10:20" and k[6] == 10 for k in got) and any(n == 0 for _, n in got.values())


def test_a_shipment_on_both_days_of_a_split_hour_counts_once(spark):
    windows = window_table(spark.createDataFrame(PLANNING[1:2], ", ".join(f"{c} string" for c in PLANNING_COLUMNS)))
    rows = [("dispatch", "0", 7, BASE.replace(hour=10, minute=50)), ("dispatch", "0", 7, BASE.replace(day=11, hour=10, minute=5))]
    got = segment_profile(frame(spark, rows), window_dictionary(windows)).collect()
    assert [(r.window_date, r.hour, r.shipments, r.first_at) for r in got] == [(BASE.date(), 10, 1, rows[0][3])]


def test_facts_are_not_multiplied_by_windows(spark):
    """Many overlapping windows: one row per event, whatever the windows; what
    meets them is bounded by segments and salts, whatever the events."""
    planning = [("0", f"{h:02d}:{m:02d}:00", "20:00:00", "21:00:00", "22:00:00") for h in range(2, 18) for m in (0, 10, 20, 30)]
    cells = hour_cells(window_dictionary(window_table(spark.createDataFrame(planning, ", ".join(f"{c} string" for c in PLANNING_COLUMNS)))))
    assert cells.filter("size(starts) > 1").count() > 10
    rows = [("receive", "0", i, BASE + dt.timedelta(hours=12, seconds=i % 3600)) for i in range(4000)]
    placed = placed_events(frame(spark, rows), cells)
    assert placed.count() == 4000
    counts = segment_counts(placed)
    assert counts.count() <= 4 * SALTS and counts.agg(F.sum("n")).first()[0] == 4000


def test_scans_are_not_multiplied_by_windows(spark):
    windows = [("0", BASE.date(), f"L{i}", f"{i % 12:02d}:{i % 60:02d} às 20:{i % 60:02d}") for i in range(120)]
    shares = spark.createDataFrame(windows, "station_id string, window_date date, window_label string, receive_planned string")
    scans = [(0, BASE + dt.timedelta(seconds=i * 17), f"op{i % 5}", 1) for i in range(5000)]
    log = spark.createDataFrame(scans, "station_id long, datetime timestamp_ntz, operator_name string, bin_received_attempt int")
    intervals = window_intervals(shares, "receive_planned", True)
    cuts = hour_cuts(intervals)
    parts = scan_segments(scan_rows(log), cuts)
    n_cuts = cuts.select(F.sum(F.size("cuts"))).first()[0]
    assert parts.count() <= (n_cuts + 24) * 5 < 5000
    got = {r.window_label: r.operators for r in operators_per_window(shares, log).collect()}
    assert got == {w[2]: 5 for w in windows}


def test_join_output_from_the_event_log():
    """A session of its own. No join of ``operators_per_window`` puts out more
    rows than scans plus elementary intervals times operators; the station-day
    has 90 overlapping windows."""
    run = subprocess.run([sys.executable, "-m", "checks.joins"], capture_output=True, text=True, cwd=ROOT, timeout=600)
    got = json.loads(run.stdout.splitlines()[-1])
    assert got["scans"] <= got["most"] <= got["scans"] + got["segments"] * got["operators"], got
    assert got["scans"] * 10 < got["pairs"], got

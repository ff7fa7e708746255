"""Column expressions on literal rows, values computed by hand."""

import datetime as dt

from pyspark.sql import functions as F

from hubflow.functions import (
    base_date,
    clock_int,
    clock_text,
    expand_close,
    expand_open,
    hhmm_from_text,
    hours,
    hub_code,
    inside_cyclic,
    instant_text,
    label_clock,
    label_instant,
    minutes_between,
    pad4,
    prefix_any,
    rate_per_hour,
    rate_per_operator,
    share_pct,
    span_label,
    trim_marker,
)
from hubflow.functions.clock import load_stamp
from hubflow.operators.curve import overnight_end, overnight_start


def one(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first()["x"]


def test_clock_text_and_bounds(spark):
    df = spark.createDataFrame([("9:30:00",), ("06:00",), ("ab:cd:00",), ("00:10:00",), ("23:30:00",)], "t string")
    rows = df.select(clock_text("t").alias("c")).select("c", hhmm_from_text("c").alias("h")).collect()
    assert [(r.c, r.h) for r in rows] == [
        ("09:30", 930),
        ("00006", 6),      # 5-char text pads to 000HH and still parses (T7)
        ("ab:cd", None),   # unparsable -> NULL
        ("00:10", 10),
        ("23:30", 2330),
    ]


def test_expand_and_labels(spark):
    df = spark.createDataFrame([(10, 600), (100, 2300), (930, 2259), (None, 1200)], "lo int, hi int")
    rows = df.select(
        expand_open("lo").alias("o"), expand_close("hi").alias("c"),
        span_label(pad4(expand_open("lo")), pad4(expand_close("hi"))).alias("l"),
    ).collect()
    assert [(r.o, r.c, r.l) for r in rows] == [
        (2330, 700, "2330 às 0700"),   # start before 01:00 -> 23:30 (T6)
        (0, 2359, "0000 às 2359"),     # start exactly 01:00 -> 00:00; end after 22:59 -> 23:59
        (830, 2359, "0830 às 2359"),
        (None, 1300, None),            # NULL bound -> NULL label
    ]


def test_inside_cyclic_and_base_date(spark):
    d = dt.date(2024, 1, 10)
    rows = [(d, hm) for hm in (2300, 30, 1200, 2330)]
    df = spark.createDataFrame(rows, "d date, hm int")
    got = df.select(
        "hm",
        inside_cyclic("hm", F.lit(2300), F.lit(100)).alias("wrap"),
        inside_cyclic("hm", F.lit(1100), F.lit(1300)).alias("plain"),
        inside_cyclic("hm", F.lit(None).cast("int"), F.lit(1300)).alias("nul"),
        base_date("d", "hm", F.lit(2300), F.lit(100)).alias("recv"),
        base_date("d", "hm", F.lit(2300), F.lit(100), default_own_day=True).alias("disp"),
    ).collect()
    prev = dt.date(2024, 1, 9)
    assert [(r.hm, r.wrap, r.plain, r.nul, r.recv, r.disp) for r in got] == [
        (2300, 1, 0, 0, d, d),
        (30, 1, 0, 0, prev, prev),      # after midnight of a wrapping window: day before
        (1200, 0, 1, 0, None, d),       # neither part: NULL for receipts, own day for dispatch
        (2330, 1, 0, 0, d, d),
    ]


def test_label_parts(spark):
    df = spark.createDataFrame([("22:00 às 03:15",), ("00006 às 00012",), ("ab:cd às 12:00",)], "l string")
    got = df.select(*[label_clock("l", p).alias(p) for p in ("start_hour", "start_minute", "end_hour", "end_minute")]).collect()
    assert [tuple(r) for r in got] == [(22, 0, 3, 15), (None, None, None, None), (None, None, 12, 0)]
    inst = df.select(label_instant(F.lit("2024-01-10").cast("date"), "l", "end").alias("e")).collect()
    assert [r.e for r in inst] == [dt.datetime(2024, 1, 10, 3, 15), None, dt.datetime(2024, 1, 10, 12, 0)]


def test_overnight_shift(spark):
    ts = [dt.datetime(2024, 1, 10, 23, 5), dt.datetime(2024, 1, 10, 1, 40), dt.datetime(2024, 1, 10, 12, 0)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    got = df.select(
        overnight_start("t", F.lit("22:00 às 03:15")).alias("s"),
        overnight_end("t", F.lit("22:00 às 03:15")).alias("e"),
        overnight_start("t", F.lit("13:00 às 18:00")).alias("plain"),
    ).collect()
    assert [(r.s, r.e, r.plain) for r in got] == [
        (ts[0], ts[0] - dt.timedelta(days=1), ts[0]),
        (ts[1] + dt.timedelta(days=1), ts[1], ts[1]),
        (ts[2] + dt.timedelta(days=1), ts[2] - dt.timedelta(days=1), ts[2]),
    ]


def test_minutes_rates_and_text(spark):
    a, b = dt.datetime(2024, 1, 1, 10, 0, 30), dt.datetime(2024, 1, 1, 9, 59, 0)
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(
        minutes_between("a", "b").alias("neg"),       # -1.5 min truncates to -1 (T11)
        minutes_between("b", "a").alias("pos"),
        instant_text("a").alias("txt"),
        clock_int("a").alias("hm"),
    ).first()
    assert (r.neg, r.pos, r.txt, r.hm) == (-1, 1, "2024-01-01 10:00", 1000)
    nums = spark.createDataFrame([(7, 0, 3), (7, 90, 0), (1, 3, None)], "t long, m long, n long")
    got = nums.select(
        rate_per_hour("t", "m").alias("rh"), rate_per_operator("t", "n").alias("ro"), hours("m").alias("h"),
    ).collect()
    assert [(g.rh, g.ro, g.h) for g in got] == [
        (None, 2, 0.0),       # zero minutes -> NULL rate (T14)
        (4, None, 1.5),
        (20, None, 0.05),
    ]
    shares = spark.createDataFrame([(7, 90), (1, 3), (1, 32)], "n long, t long")
    assert [r.s for r in shares.select(share_pct("n", "t").alias("s")).collect()] == [7.78, 33.33, 3.13]


def test_codes(spark):
    df = spark.createDataFrame(
        [("XPT-SP-000", "HUB-SP-001X"), ("XPT-SP-004", "HUB-SP-005"), ("HUB-SP-001", "HUB-SP-001"), ("LMX-SP-002", None)],
        "code string, sup string",
    )
    got = df.select(hub_code("code", "sup").alias("h"), trim_marker("sup").alias("t")).collect()
    assert [(g.h, g.t) for g in got] == [
        ("HUB-SP-001", "HUB-SP-001"),
        ("HUB-SP-005", "HUB-SP-005"),
        ("HUB-SP-001", "HUB-SP-001"),
        ("LMX-SP-002", None),
    ]
    p = spark.createDataFrame([("LM Hub_1",), ("XPT_4",), ("RTS_3",), (None,)], "n string")
    assert [r.x for r in p.select(prefix_any("n", ["LM", "XPT"]).alias("x")).collect()] == [True, True, False, None]


def test_load_stamp(spark):
    r = spark.range(1).select(load_stamp("2024-01-31 12:00:00").alias("s")).first()
    assert r.s == dt.datetime(2024, 1, 31, 1, 0)


def test_share_scale_option(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 32)], "n long, t long")
    got = [r.s for r in df.select(share_pct("n", "t", scale=1).alias("s")).collect()]
    assert got == [33.3, 66.7, 3.1]

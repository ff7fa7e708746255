"""
worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from hubflow.operators.backlog import hub_lookup, hub_rows, latest_per_key, latest_snapshot, station_dim, status_pivot
from hubflow.operators.classify import classify_receipts, receipt_rows, receipts_inside, receipts_outside
from hubflow.operators.filters import drop_sentinels, require_text
from hubflow.operators.profile import hour_profile, window_shares
from hubflow.operators.windows import window_table
from hubflow.plans.backlog import metric_conditions

D = dt.date(2024, 1, 10)


def ts(h, m, day=D):
    return dt.datetime(day.year, day.month, day.day, h, m)


def planning(spark, rows):
    return spark.createDataFrame(
        rows,
        "station_id string, labeling_start_time string, labeling_end_time string, "
        "dispatching_start_time_fleet string, dispatching_end_time_fleet string",
    )


def shipments(spark, rows):
    """rows: (station, shipment, instant, received_attempt)"""
    data = [(s, sh, t.date(), t, a, t, 1) for s, sh, t, a in rows]
    return spark.createDataFrame(
        data,
        "station_id long, shipment_id long, data date, datetime_received timestamp_ntz, "
        "received_attempt int, datetime_delivering timestamp_ntz, delivering_attempt int",
    )


def test_t6_early_window_wraps_and_moves_to_previous_day(spark):
    win = window_table(planning(spark, [("1", "00:10:00", "06:00:00", "07:00:00", "11:00:00")]))
    facts = shipments(spark, [(1, 10, ts(0, 20), 1), (1, 11, ts(23, 45), 1), (1, 12, ts(12, 0), 1)])
    got = {r.shipment_id: r for r in classify_receipts(receipt_rows(facts, "2024-01-20"), win).collect()}
    assert (got[10].inside, got[10].window_date) == (1, dt.date(2024, 1, 9))  # after midnight -> day before
    assert (got[11].inside, got[11].window_date) == (1, D)
    assert (got[12].inside, got[12].window_date) == (0, None)


def test_t7_unparsable_start_is_never_inside(spark):
    win = window_table(planning(spark, [("1", "ab:cd:00", "12:00:00", "13:00:00", "18:00:00")]))
    facts = shipments(spark, [(1, 10, ts(9, 0), 1)])
    r = classify_receipts(receipt_rows(facts, "2024-01-20"), win).first()
    assert (r.inside, r.window_label, r.receive_planned) == (0, None, "ab:cd às 12:00")


def test_require_text_and_sentinels(spark):
    p = planning(spark, [("1", "", "1", "1", "1"), ("1", None, "1", "1", "1"), ("1", "1", "1", "1", "1")])
    assert require_text(p, "labeling_start_time").count() == 1
    ids = spark.createDataFrame([(v,) for v in ["-", "?", ".", "", "Inativo", "Inactive", None, "7"]], "station_id string")
    assert [r.station_id for r in drop_sentinels(ids).collect()] == ["7"]


def test_t13_outside_is_masked_by_any_inside_match(spark):
    win = window_table(planning(spark, [("1", "08:00:00", "10:00:00", "11:00:00", "12:00:00")]))
    # shipment 5 is inside at station 1 but also received at station 2 (no window): masked
    facts = shipments(spark, [(1, 5, ts(8, 30), 1), (2, 5, ts(15, 0), 1), (2, 6, ts(15, 0), 1)])
    rows = receipt_rows(facts, "2024-01-20")
    out = receipts_outside(rows, receipts_inside(classify_receipts(rows, win)))
    assert [(r.shipment_id, r.window_label) for r in out.collect()] == [(6, "fora da janela")]


def test_t2_colliding_expanded_labels_cross_multiply(spark):
    win = window_table(planning(spark, [
        ("1", "00:10:00", "06:00:00", "07:00:00", "11:00:00"),
        ("1", "00:40:00", "06:00:00", "07:00:00", "11:00:00"),
    ]))
    facts = shipments(spark, [(1, 1, ts(1, 0), 1), (1, 2, ts(1, 30), 1), (1, 3, ts(2, 0), 1)])
    inside = receipts_inside(classify_receipts(receipt_rows(facts, "2024-01-20"), win))
    keys = ["station_id", "window_date", "window_label", "receive_planned", "receive_expanded"]
    shares = window_shares(hour_profile(inside, "received_at", keys), keys)
    # both planned windows see all 3 shipments (same expansion) -> totals 3 and 3;
    # each hour row meets both totals rows: 2 planned x 2 hours x 2 totals
    assert shares.count() == 8
    assert sorted({r.share for r in shares.collect()}) == [33.33, 66.67]


def test_t15_latest_rows_keep_ties_and_drop_null_keys(spark):
    log = spark.createDataFrame(
        [(1, 1, "a"), (1, 3, "b"), (1, 3, "c"), (2, 5, "d"), (None, 9, "e")],
        "shipment_id long, station_sequence int, tag string",
    )
    assert sorted(r.tag for r in latest_per_key(log, "shipment_id", "station_sequence").collect()) == ["b", "c", "d"]
    # the max is over all rows of the shipment, before other filters
    subset = log.filter(F.col("tag") != "b").filter(F.col("tag") != "c")
    assert sorted(r.tag for r in latest_per_key(subset, "shipment_id", "station_sequence", within=log).collect()) == ["d"]


def test_t16_metrics_overlap(spark):
    rows = spark.createDataFrame(
        [(1, 15, "SoC_1"), (2, 15, "LM Hub_2"), (3, 36, "LM Hub_3"), (4, 36, "SoC_4"), (5, 8, "XPT_5")],
        "shipment_id long, latest_spx_tracking_code int, next_point string",
    ).withColumn("k", F.lit(1))
    r = status_pivot(rows, ["k"], metric_conditions()).first().asDict()
    assert r["SOC_LHTransporting"] == 2
    assert r["SoC_to_SoC"] == 2
    assert r["SoC_to_LM_transporting"] == 1
    assert r["SoC_to_LM_transported"] == 1
    assert r["1st_SOC_Received"] == 1


def test_t17_t18_station_dim_and_hub_lookup(spark):
    raw = spark.createDataFrame(
        [
            ("1", "R", "S", "HUB-SP-001", "LM Hub_1", "HUB-SP-001"),
            ("5", "R", "S", "HUB-SP-001", "LM Hub_5", "HUB-SP-001"),  # second HUB row, same hub code
            ("8", "R", "S", "HUB-SP-001X", "XPT_8", "XPT-SP-008"),
            ("x9", "R", "S", "HUB-SP-009", "LM Hub_9", "LMX-SP-009"),  # non-numeric id: NULL, no failure
        ],
        "station_id string, regional string, sub_regional string, superior_station_code string, "
        "station_name string, station_code string",
    )
    dim = station_dim(raw)
    assert sorted((r.station_id or -1, r.superior_code_hub) for r in dim.collect()) == [
        (-1, "LMX-SP-009"), (1, "HUB-SP-001"), (5, "HUB-SP-001"), (8, "HUB-SP-001"),
    ]
    rows = spark.createDataFrame([("HUB-SP-001",), ("LMX-SP-009",)], "superior_code_hub string")
    got = sorted((r.superior_code_hub, r.hub_station_id) for r in hub_lookup(rows, hub_rows(dim)).collect())
    assert got == [("HUB-SP-001", 1), ("HUB-SP-001", 5), ("LMX-SP-009", None)]


def test_t20_latest_snapshot_keeps_duplicate_names(spark):
    snap = spark.createDataFrame(
        [("A", dt.date(2024, 1, 29)), ("A", dt.date(2024, 1, 30)), ("A", dt.date(2024, 1, 30)), ("B", dt.date(2024, 1, 29))],
        "station_name string, grass_date date",
    )
    assert sorted(r.station_name for r in latest_snapshot(snap).collect()) == ["A", "A"]


def _shares(spark, shipments):
    """One window-day whose hours have the given numbers of shipments."""
    from hubflow.operators.profile import hour_shares

    total = sum(shipments)
    profile = spark.createDataFrame(
        [("1", D, "L", "P", "E", h, ts(h, 5), n) for h, n in enumerate(shipments)],
        "station_id string, window_date date, window_label string, receive_planned string, receive_expanded string, hour int, first_at timestamp_ntz, shipments long",
    )
    totals = spark.createDataFrame([("1", D, "L", total)], "station_id string, window_date date, window_label string, window_total long")
    return lambda scale=None: hour_shares(profile, totals, scale)


def test_t1_hours_at_or_below_the_low_threshold_are_cut(spark):
    from hubflow.operators.classify import RECEIPT_KEYS
    from hubflow.operators.curve import curve_stats
    from hubflow.plans.shift import CURVE_SPAN_PCT, SHIFT_SPAN_PCT, VOLUME_PCT

    # shares 0.05, 0.06, 5.00, 94.89: the first is at the low threshold
    shares = _shares(spark, [5, 6, 500, 9489])()
    low = curve_stats(shares, RECEIPT_KEYS, VOLUME_PCT, SHIFT_SPAN_PCT).first()
    high = curve_stats(shares, RECEIPT_KEYS, VOLUME_PCT, CURVE_SPAN_PCT).first()
    assert (low.curve_start, low.curve_end) == (ts(1, 5), ts(3, 5))
    assert (high.curve_start, high.curve_end) == (ts(3, 5), ts(3, 5))
    assert low.curve_volume == high.curve_volume == 9489
    assert curve_stats(shares, RECEIPT_KEYS, VOLUME_PCT, 0).first().curve_start == ts(0, 5)


def test_n5_one_decimal_shares_change_the_curve(spark):
    from hubflow.operators.classify import RECEIPT_KEYS
    from hubflow.operators.curve import curve_stats
    from hubflow.plans.shift import CURVE_SPAN_PCT, VOLUME_PCT

    shares = _shares(spark, [503, 9497])  # 5.03 %: above 5, but 5.0 with one decimal
    two, one = (curve_stats(shares(scale), RECEIPT_KEYS, VOLUME_PCT, CURVE_SPAN_PCT).first() for scale in (None, 1))
    assert (two.curve_volume, two.curve_start) == (10000, ts(0, 5))
    assert (one.curve_volume, one.curve_start) == (9497, ts(1, 5))


def test_n5_share_scale_reaches_the_report(spark):
    """19 of 378 receipts are 5.03 %: in the curve with two decimals only."""
    from hubflow.plans.shift import curve_productivity
    from hubflow.sources.testdata import Inputs

    at = [ts(7, 0)] * 19 + [ts(9, 0)] * 359
    facts = shipments(spark, [(1, i, t, 1) for i, t in enumerate(at)])
    stations = spark.createDataFrame([("1", "R", "S", "HUB-SP-001", "LM Hub_1", "HUB-SP-001")], "station_id string, regional string, sub_regional string, superior_station_code string, station_name string, station_code string")
    scans = spark.createDataFrame([], "station_id long, datetime timestamp_ntz, operator_name string, bin_received_attempt int")
    inp = Inputs(facts, scans, planning(spark, [("1", "06:00:00", "12:00:00", "13:00:00", "18:00:00")]), stations, None, None)
    volumes = [curve_productivity(inp, dt.date(2024, 1, 20), share_scale=s).first().total_da_curva_received for s in (None, 1)]
    assert volumes == [378, 359]


def test_as_of_may_be_a_date_a_text_or_a_column(spark):
    from hubflow.operators.classify import fact_events

    facts = shipments(spark, [(1, 1, ts(9, 0), 1), (1, 2, ts(9, 0, dt.date(2023, 1, 1)), 1)])
    forms = ["2024-01-20", dt.date(2024, 1, 20), F.lit("2024-01-20").cast("date")]
    got = [sorted((r.direction, r.shipment_id) for r in fact_events(facts, a).collect()) for a in forms]
    assert got == [[("dispatch", 1), ("dispatch", 2), ("receive", 1)]] * 3
    assert all(receipt_rows(facts, a).count() == 1 for a in forms)


def test_o16_a_code_of_its_own_may_end_in_the_marker(spark, inputs):
    codes = {r.code_name: r.superior_code_hub for r in station_dim(inputs.stations).collect()}
    assert any(own.endswith("X") and own == hub for own, hub in codes.items())


def test_t18_a_malformed_id_matches_no_station_and_ends_nothing(spark, inputs):
    from hubflow.plans.backlog import backlog_rows
    from hubflow.sources.testdata import Inputs

    log = inputs.tracking.withColumn("final_spx_station_id", F.when(F.col("shipment_id") % 2 == 0, "12a").otherwise(F.col("final_spx_station_id").cast("string")))
    rows = backlog_rows(Inputs(None, None, None, inputs.stations, log, inputs.snapshot))
    bad = rows.filter("final_spx_station_id = '12a'")
    assert bad.count() > 0 and bad.filter("superior_code_hub IS NOT NULL").count() == 0
    assert rows.count() == backlog_rows(inputs).count()


def test_windows_grow_with_the_data(spark):
    from hubflow.sources.testdata import load_inputs

    n = [window_table(load_inputs(spark, f"/root/testdata/{sf}").planning).count() for sf in ("sf0.001", "sf0.01")]
    assert n[1] > 3 * n[0]

"""Planning sheet -> windows, on the fixture sheet (FIXTURES.md section 2)."""

from hubflow.operators.windows import window_table


def test_window_table(inputs):
    w = {(r.station_id, r.receive_planned, r.dispatch_planned): r for r in window_table(inputs.planning).collect()}
    # 16 literal rows, of which one exact duplicate, one empty and one NULL time
    # drop, and one window for each of the 10 suppliers
    assert len(w) == 13 + 10
    r = w[("2", "00:10 às 06:00", "07:00 às 11:00")]
    assert (r.receive_open, r.receive_close, r.receive_expanded) == (2330, 700, "2330 às 0700")
    # another planned window with the same expanded label
    assert w[("2", "00:40 às 06:00", "07:00 às 11:00")].receive_expanded == "2330 às 0700"
    t7 = w[("4", "00006 às 00012", "00013 às 00018")]
    assert (t7.receive_start, t7.receive_open, t7.receive_close) == (6, 2330, 112)
    bad = w[("4", "ab:cd às 12:00", "13:00 às 18:00")]
    assert bad.receive_start is None and bad.receive_expanded is None and bad.dispatch_start == 1300
    late = w[("2", "17:00 às 23:30", "00:30 às 04:00")]
    assert (late.receive_close, late.dispatch_open, late.dispatch_expanded) == (2359, 2330, "2330 às 0500")
    unpadded = w[("1", "09:30 às 15:30", "22:00 às 03:15")]
    assert (unpadded.receive_open, unpadded.dispatch_start, unpadded.dispatch_end) == (830, 2200, 315)

"""Hour profiles of both directions without multiplying the facts by windows.

Every bound of a station's windows cuts the clock. Between two cuts all events
are inside the same windows, so an event needs no window: it is placed in the
clock segment that its minute falls in, named by the minute at which the segment
begins within the hour (0..59). A shipment's events of an hour become one row per
segment, with the set of all its segments in that hour as a 64-bit mask, and
these become counts per (mask, segment). Only the counts, a few rows an hour
however many shipments there are, meet the windows.

The result is exactly that of joining each event with each window of its
station and counting distinct shipments:

* a window counts the shipments of a mask at the first of its segments that lies
  in the window, so once, and takes first instants from all that do;
* a window that passes midnight and begins and ends in one hour (23:30 to 23:10)
  takes that hour's events from two days. There alone a shipment could be
  counted twice, so in such an hour of its station shipments stay rows of their
  own, and that window counts them as a set.

The facts are exchanged once, the counts once. Windows travel as small integers
(``window_dictionary``), their texts are joined back at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.functions.clock import base_date, inside_cyclic
from hubflow.operators.filters import drop_label

RECEIVE, DISPATCH = "receive", "dispatch"
SITE = ["direction", "station_id"]
#: Over how many keys the shipments of a station's hour are dealt.
SALTS = 32
WINDOW_TEXTS = ["window_label", "planned", "expanded"]


def window_dictionary(windows: DataFrame) -> DataFrame:
    """One row per direction, station and distinct window of that direction:
    its texts, clock bounds (``lo``, ``hi``) and numbers: ``window_no`` its own,
    ``group_no`` of its label (windows whose totals and curves meet), ``pool_no``
    of the label that its operators are pooled by. Numbers are dense within a direction and station, and depend on the labels alone. A receive
    window planned with several dispatch windows is one row, and so the other
    way round. Windows without a label or a bound hold nothing and are left
    out."""
    label = F.col("receive_expanded").alias("window_label")
    receive = windows.select(
        F.lit(RECEIVE).alias("direction"), "station_id", label,
        F.col("receive_planned").alias("planned"), F.col("receive_expanded").alias("expanded"),
        F.col("receive_open").alias("lo"), F.col("receive_close").alias("hi"),
    )
    dispatch = windows.select(
        F.lit(DISPATCH).alias("direction"), "station_id", label,
        F.col("dispatch_planned").alias("planned"), F.col("dispatch_expanded").alias("expanded"),
        F.col("dispatch_start").alias("lo"), F.col("dispatch_end").alias("hi"),
    )
    known = drop_label(receive.unionByName(dispatch)).dropna(subset=["lo", "hi"]).repartition(*SITE).distinct()
    site = Window.partitionBy(*SITE)
    pool = F.when(F.col("direction") == RECEIVE, F.col("window_label")).otherwise(F.col("planned"))
    return known.select(
        "*",
        F.dense_rank().over(site.orderBy(*WINDOW_TEXTS)).alias("window_no"),
        F.dense_rank().over(site.orderBy("window_label")).alias("group_no"),
        F.dense_rank().over(site.orderBy(pool)).alias("pool_no"),
    )


def hour_cells(dictionary: DataFrame) -> DataFrame:
    """Each direction, station and hour of the day with the minutes at which its
    clock segments begin (``starts``: 0 and each cut within the hour); ``split``
    if some window takes the hour from two days. A station has at most as many cuts as the clock has minutes. Hours come from an
    explode after the aggregation, so that a join with the cells has an exchange
    of its own, in which AQE can split a station of very many facts."""
    cuts = F.flatten(F.collect_set(F.array(F.col("lo"), F.col("hi") + 1)))
    lo, hi = F.floor(F.col("lo") / 100), F.floor(F.col("hi") / 100)
    two_days = F.collect_set(F.when((F.col("lo") > F.col("hi")) & (lo == hi), lo.cast("int")))
    sites = dictionary.groupBy(*SITE).agg(F.array_distinct(cuts).alias("cuts"), two_days.alias("two_days"))
    hours = sites.select(*SITE, "cuts", "two_days", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    minutes = F.transform("cuts", lambda c: c - F.col("hour") * 100)
    inside = F.filter(minutes, lambda m: (m > 0) & (m < 60))
    starts = F.array_sort(F.array_union(F.array(F.lit(0)), inside))
    return hours.select(*SITE, "hour", starts.alias("starts"), F.array_contains("two_days", F.col("hour")).alias("split"))


def hour_cover(dictionary: DataFrame, cells: DataFrame) -> DataFrame:
    """The segments of each hour that lie in each window (``covers``, a mask by
    the minute at which they begin) and ``shift``, the days from the event's to
    the window's date. ``as_set`` marks the hours that this window takes from
    two days."""
    day = F.to_date(F.lit("2000-01-02"))
    hm = F.col("hour") * 100 + F.col("start")
    segments = cells.select(*SITE, "hour", F.explode("starts").alias("start"))
    inside = segments.join(dictionary, SITE).filter(inside_cyclic(hm, "lo", "hi") == 1)
    keys = [*SITE, "group_no", "window_no", "hour"]
    covers = (
        inside.select(*keys, F.date_diff(base_date(day, hm, "lo", "hi"), day).alias("shift"), _bit("start").alias("bit"))
        .groupBy(*keys, "shift")
        .agg(F.bit_or("bit").alias("covers"))
    )
    return covers.withColumn("as_set", F.count("*").over(Window.partitionBy(*keys)) > 1)


def _bit(minute: str) -> Column:
    return F.expr(f"shiftleft(1L, {minute})")


def placed_events(events: DataFrame, cells: DataFrame) -> DataFrame:
    """Events (direction, station, shipment, ``event_at``, ``event_hhmm``) in
    their clock segments, ``start``. A station's hour is dealt by shipment over
    ``SALTS`` keys, so that a very large station is spread over many tasks."""
    hour = F.floor(F.col("event_hhmm") / 100).cast("int")
    minute = F.col("event_hhmm") % 100
    salt = F.pmod(F.xxhash64(F.coalesce("shipment_id", F.unix_micros(F.col("event_at").cast("timestamp")))), F.lit(SALTS)).cast("int")
    return (
        events.withColumn("hour", hour)
        .join(cells, [*SITE, "hour"])
        .select(
            *SITE,
            F.to_date("event_at").alias("day"),
            "hour",
            salt.alias("salt"),
            "shipment_id",
            F.array_max(F.filter("starts", lambda s: s <= minute)).alias("start"),
            "split",
            "event_at",
        )
        .repartition(*SITE, "day", "hour", "salt")
    )


def segment_counts(placed: DataFrame) -> DataFrame:
    """``placed_events`` to, per station, day, hour, set of segments (``mask``)
    and segment of the set: the shipments with that set (``n``) and the first
    instant in the segment; in ``split`` hours one row a shipment, with its id.
    Nothing is exchanged; a salt counts on its own."""
    base = [*SITE, "day", "hour", "salt"]
    once = placed.groupBy(*base, "split", "shipment_id", "start").agg(F.min("event_at").alias("first_at"))
    mask = F.bit_or(_bit("start")).over(Window.partitionBy(*base, "shipment_id"))
    kept = F.when(F.col("split"), F.col("shipment_id")).alias("kept_id")
    counts = once.select("*", mask.alias("mask"), kept).groupBy(*base, "mask", "start", "kept_id")
    return counts.agg(F.count("shipment_id").alias("n"), F.min("first_at").alias("first_at"))


def segment_profile(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """First instant (``first_at``) and distinct shipments per window, window
    date and hour of day, windows by number. The rows are partitioned by
    direction, station, ``group_no`` and window date."""
    cells = hour_cells(dictionary)
    counts = segment_counts(placed_events(events, cells))
    shared = F.col("mask").bitwiseAND(F.col("covers"))
    is_first = shared.bitwiseAND(-shared) == _bit("start")
    window = [*SITE, "group_no", "window_no", F.date_add("day", F.col("shift")).alias("window_date"), "hour"]
    met = (
        counts.join(hour_cover(dictionary, cells), [*SITE, "hour"])
        .filter(_bit("start").bitwiseAND(F.col("covers")) != 0)
        .select(*window, F.when(is_first & ~F.col("as_set"), F.col("n")).otherwise(0).alias("n"), F.when(F.col("as_set"), F.col("kept_id")).alias("kept_id"), "first_at")
    )
    return (
        met.repartition(*SITE, "group_no", "window_date")
        .groupBy(*SITE, "group_no", "window_no", "window_date", "hour")
        .agg(F.min("first_at").alias("first_at"), (F.sum("n") + F.count_distinct("kept_id")).alias("shipments"))
    )

"""The job inputs, derived from the driver's test tables (see FIXTURES.md).

The reference reads six warehouse tables that the test data does not have;
each is derived here from ``events``, ``lineitem``, ``supplier``, ``nation``
and ``region`` with plain column expressions, so every input grows with the
scale factor except the station dimensions, which are small by nature. The
literal planning rows are also used by the DuckDB oracle
(``checks/oracle.py``), so both engines read the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the test mapping --------------------------------------
AS_OF = "2024-01-31"                 # the events span 2024-01-01 .. 2024-01-30
AS_OF_TS = "2024-01-31 12:00:00"
STATION_COUNT = 100                  # station_id = user_id % 100
TRACKING_CODES = [8, 9, 33, 15, 630, 36, 99]   # picked by l_partkey % 7
SENTINEL_NATIONS = {2: "Inativo", 6: "-", 22: ""}
SNAPSHOT_PREFIXES = ["SoC_", "LM Hub_", "XPT_"]
SNAPSHOT_DATES = ["2024-01-28", "2024-01-29", "2024-01-30"]
SNAPSHOT_ZONES = ["local", "utc"]
SNAPSHOT_EXTRA = ("LM Hub_7", "2024-01-30", "local", "BR")
# Planning rows: station, labeling start, end, dispatching start, end.
PLANNING_ROWS = [
    ("0", "06:00:00", "12:00:00", "13:00:00", "18:00:00"),
    ("0", "14:00:00", "20:00:00", "20:30:00", "23:30:00"),
    ("1", "22:00:00", "04:00:00", "05:00:00", "09:30:00"),
    ("1", "9:30:00", "15:30:00", "22:00:00", "03:15:00"),
    ("2", "00:10:00", "06:00:00", "07:00:00", "11:00:00"),
    ("2", "00:40:00", "06:00:00", "07:00:00", "11:00:00"),
    ("2", "17:00:00", "23:30:00", "00:30:00", "04:00:00"),
    ("3", "06:00:00", "14:00:00", "15:00:00", "19:00:00"),
    ("3", "06:00:00", "14:00:00", "16:00:00", "21:00:00"),
    ("3", "06:00:00", "14:00:00", "15:00:00", "19:00:00"),
    ("4", "06:00", "12:00", "13:00", "18:00"),
    ("4", "ab:cd:00", "12:00:00", "13:00:00", "18:00:00"),
    ("4", "", "12:00:00", "13:00:00", "18:00:00"),
    ("4", None, "12:00:00", "13:00:00", "18:00:00"),
    ("4", "08:00:00", "16:00:00", "17:00:00", "22:00:00"),
    ("9", "01:00:00", "05:00:00", "06:00:00", "09:00:00"),
]
PLANNING_COLUMNS = [
    "station_id",
    "labeling_start_time",
    "labeling_end_time",
    "dispatching_start_time_fleet",
    "dispatching_end_time_fleet",
]
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Inputs:
    """The six inputs of the reports, with the reference's column names."""

    shipments: DataFrame   # shipment facts
    scans: DataFrame       # operator scan log
    planning: DataFrame    # planned daily windows
    stations: DataFrame    # station dimension (raw, ids as text)
    tracking: DataFrame    # parcel tracking log
    snapshot: DataFrame    # dated station snapshot


# Columns read from the driver tables. Giving the schema skips the footer
# inference job at read time, and the scan reads just these columns.
SOURCE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "supplier": "s_suppkey BIGINT",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shipment_facts(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % STATION_COUNT).alias("station_id"),
        F.expr("event_id div 2").alias("shipment_id"),
        F.to_date("ts").alias("data"),
        F.col("ts").alias("datetime_received"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("received_attempt"),
        (F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("datetime_delivering"),
        F.when(F.col("event_type") == "view", 2).otherwise(1).alias("delivering_attempt"),
    )


def scan_log(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % STATION_COUNT).alias("station_id"),
        F.col("ts").alias("datetime"),
        F.when(F.col("user_id") % 50 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("op"), F.col("user_id").cast("string")))
        .alias("operator_name"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("bin_received_attempt"),
    )


def _sql_text(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'"


def _clock_text(hour, minute) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00"))


def planning_sheet(spark: SparkSession, supplier: DataFrame) -> DataFrame:
    """One planned window per supplier, so that windows grow with the data, and
    the rows of ``PLANNING_ROWS`` for the odd cases."""
    k = F.col("s_suppkey")
    half = k % 2 * 30
    grown = supplier.select(
        (k % STATION_COUNT).cast("string"),
        _clock_text(k * 5 % 24, half),
        _clock_text((k * 5 + 6 + k % 5) % 24, half),
        _clock_text((k * 5 + 12) % 24, F.lit(0)),
        _clock_text((k * 5 + 15 + k % 6) % 24, F.lit(45)),
    ).toDF(*PLANNING_COLUMNS)
    rows = ", ".join("(" + ", ".join(_sql_text(v) for v in row) + ")" for row in PLANNING_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS planning({', '.join(PLANNING_COLUMNS)})").union(grown)


def station_dimension(nation: DataFrame, region: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    sid = (
        F.when(n == 2, F.lit(SENTINEL_NATIONS[2]))
        .when(n == 6, F.lit(SENTINEL_NATIONS[6]))
        .when(n == 22, F.lit(SENTINEL_NATIONS[22]))
        .otherwise(n.cast("string"))
    )
    code_prefix = F.when(n % 4 == 0, "XPT-SP-").when(n % 4 == 1, "HUB-SP-").otherwise("LMX-SP-")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        sid.alias("station_id"),
        F.col("r_name").alias("regional"),
        F.col("n_name").alias("sub_regional"),
        F.concat(
            F.lit("HUB-SP-"),
            F.lpad((n - n % 4 + 1).cast("string"), 3, "0"),
            F.when(n % 8 == 0, "X").otherwise(""),
        ).alias("superior_station_code"),
        F.concat(F.when(n % 4 == 0, "XPT_").otherwise("LM Hub_"), n.cast("string")).alias(
            "station_name"
        ),
        F.concat(code_prefix, F.lpad(n.cast("string"), 3, "0"), F.when(n % 8 == 2, "X").otherwise("")).alias("station_code"),
    )


def tracking_log(lineitem: DataFrame) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in TRACKING_CODES])
    supp5 = (F.col("l_suppkey") % 5).cast("string")
    final = F.col("l_suppkey") % 25
    return lineitem.select(
        F.col("l_orderkey").alias("shipment_id"),
        F.col("l_linenumber").alias("station_sequence"),
        F.element_at(codes, (F.col("l_partkey") % 7 + 1).cast("int")).alias(
            "latest_spx_tracking_code"
        ),
        F.concat(
            F.when(F.col("l_suppkey") % 10 < 9, "SoC_").otherwise("LM Hub_"), supp5
        ).alias("latest_spx_location"),
        (F.col("l_suppkey") % 5).alias("actual_station_id"),
        F.concat(F.lit("SoC_"), supp5).alias("actual_station_name"),
        F.concat(
            F.when(F.col("l_quantity") < 5, "SoC_")
            .when(F.col("l_quantity") < 45, "LM Hub_")
            .otherwise("XPT_"),
            (F.col("l_partkey") % 25).cast("string"),
        ).alias("next_point"),
        final.alias("final_spx_station_id"),
        F.concat(
            F.when(final % 4 == 0, "XPT_").when(final % 4 == 3, "RTS_").otherwise("LM Hub_"),
            final.cast("string"),
        ).alias("final_spx_station_name"),
    )


def station_snapshot(nation: DataFrame) -> DataFrame:
    """Nation (without 24) x prefixes x dates x zones, generated by explode
    (no join), plus one duplicate-name row."""
    n = F.col("n_nationkey")
    rows = (
        nation.filter(n != 24)
        .select(n, F.explode(F.array(*[F.lit(p) for p in SNAPSHOT_PREFIXES])).alias("prefix"))
        .select(n, "prefix", F.explode(F.array(*[F.lit(d) for d in SNAPSHOT_DATES])).alias("day"))
        .select(n, "prefix", "day", F.explode(F.array(*[F.lit(z) for z in SNAPSHOT_ZONES])).alias("tz"))
        .select(
            F.concat(F.col("prefix"), n.cast("string")).alias("station_name"),
            F.to_date("day").alias("grass_date"),
            F.col("tz").alias("tz_type"),
            F.when(n % 11 == 10, "MX").otherwise("BR").alias("grass_region"),
        )
    )
    name, day, tz, region = SNAPSHOT_EXTRA
    extra = nation.filter(n == 7).select(
        F.lit(name).alias("station_name"),
        F.to_date(F.lit(day)).alias("grass_date"),
        F.lit(tz).alias("tz_type"),
        F.lit(region).alias("grass_region"),
    )
    return rows.unionByName(extra)


class DriverTables:
    """The six inputs over the test tables in ``sf_dir``, each derived on
    first use: a query that touches two of them does not build the others.
    Has the same attributes as :class:`Inputs`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _events(self) -> DataFrame:
        return _table(self.spark, self.sf_dir, "events")

    @cached_property
    def _nation(self) -> DataFrame:
        return _table(self.spark, self.sf_dir, "nation")

    @cached_property
    def shipments(self) -> DataFrame:
        return shipment_facts(self._events)

    @cached_property
    def scans(self) -> DataFrame:
        return scan_log(self._events)

    @cached_property
    def planning(self) -> DataFrame:
        return planning_sheet(self.spark, _table(self.spark, self.sf_dir, "supplier"))

    @cached_property
    def stations(self) -> DataFrame:
        return station_dimension(self._nation, _table(self.spark, self.sf_dir, "region"))

    @cached_property
    def tracking(self) -> DataFrame:
        return tracking_log(_table(self.spark, self.sf_dir, "lineitem"))

    @cached_property
    def snapshot(self) -> DataFrame:
        return station_snapshot(self._nation)


def load_inputs(spark: SparkSession, sf_dir: str) -> DriverTables:
    """The job inputs over the test tables in ``sf_dir`` (built lazily)."""
    return DriverTables(spark, sf_dir)

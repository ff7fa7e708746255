"""Session settings.

``SCALE_CONF`` is what the jobs are designed for on a large cluster: AQE
re-plans at each shuffle (coalesces small partitions, splits skewed ones and
switches to broadcast joins from measured sizes), and many initial shuffle
partitions of a bounded advisory size keep every task within executor
memory whatever the input size. ``scale_session`` applies them; ``local_session`` is the small-machine
variant used by the benchmark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # start wide, let AQE coalesce: a 100 TB job needs thousands of reducers
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
    # no join is hinted: a side is broadcast when its size is below this
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoints written by the jobs are deleted once their frame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_session(app: str = "hubflow", **conf) -> SparkSession:
    """A session on the cluster that the environment names, with ``SCALE_CONF``;
    ``conf`` overrides single settings."""
    return SparkSession.builder.appName(app).config(map={**SCALE_CONF, **conf}).getOrCreate()


def local_session(cores: int = 8, app: str = "hubflow", **conf) -> SparkSession:
    """A local session: AQE on, shuffle partitions = cores, no UI."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # checkpointed frames have no size, so Spark takes them for large and reads
        # a small scan log once more to filter them by
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")
        # small shuffles still use all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

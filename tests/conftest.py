import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from hubflow.sources.sinks import shared_dir

    s = (
        SparkSession.builder.master("local[*]")
        .appName("hubflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)  # sets a checkpoint folder only where none is configured
    yield s
    s.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from hubflow.sources.testdata import load_inputs

    return load_inputs(spark, SF_SMALL)

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("ORACLE_SF", "0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("levyscope-tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from levyscope.scale import release

    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"/root/testdata/sf{SF}"


@pytest.fixture
def distributed(monkeypatch, spark):
    """Every size check fails, so each operator takes the form meant for large data, over several partitions."""
    from levyscope import scale

    monkeypatch.setattr(scale, "SMALL_ROWS", 0)
    monkeypatch.setattr(scale, "SALTS", 4)
    forced = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in forced.items():
        spark.conf.set(key, value)
    yield
    for key in forced:
        spark.conf.unset(key)

"""Feeds keep their last whole version."""

import pytest
from pyspark.sql import functions as F

from levyscope.sources import sinks


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_failed_write_leaves_the_feed(spark, tmp_path):
    out = str(tmp_path)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    feed, version = f"{out}/feed", sinks.write_feed(first, "feed", out)
    assert rows(spark.read.parquet(version)) == rows(first)
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_feed(bad, "feed", out)
    assert rows(sinks.read_feed(spark, feed)) == [(1, "a"), (2, "b")]
    third = spark.createDataFrame([(3, 0.5)], "n int, x double")
    assert sinks.write_feed(third, "feed", out).startswith(feed)
    assert rows(sinks.read_feed(spark, feed)) == [(3, 0.5)]


def test_dying_before_the_pointer_moves(spark, tmp_path, monkeypatch):
    feed = str(tmp_path / "feed")
    sinks.write_feed(spark.range(3), "feed", str(tmp_path))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks, "_rename_over", die)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_feed(spark.range(9), "feed", str(tmp_path))
    assert sinks.read_feed(spark, feed).count() == 3
    assert sinks.current_version(spark, feed)["rows"] == 3


def test_versions_partitions_and_missing_files(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "n int, part int")
    feed = str(tmp_path / "feed")
    for _ in range(4):
        sinks.write_feed(df, "feed", str(tmp_path), ["part"])
    assert len([p for p in (tmp_path / "feed").iterdir() if p.name.startswith("v")]) == sinks.KEPT
    assert rows(sinks.read_feed(spark, feed).select("n", "part")) == rows(df)
    manifest = sinks.current_version(spark, feed)
    assert manifest["rows"] == 9 and all(name.startswith("part=") for name in manifest["files"])
    gone = tmp_path / "feed" / manifest["version"] / min(manifest["files"])
    gone.rename(tmp_path / "elsewhere")
    with pytest.raises(OSError, match="missing"):
        sinks.read_feed(spark, feed)
    with pytest.raises(FileNotFoundError):
        sinks.read_feed(spark, str(tmp_path / "none"))


def test_an_empty_feed(spark, tmp_path):
    feed = str(tmp_path / "feed")
    sinks.write_feed(spark.createDataFrame([], "n int"), "feed", str(tmp_path))
    assert sinks.read_feed(spark, feed).columns == ["n"] and sinks.read_feed(spark, feed).count() == 0

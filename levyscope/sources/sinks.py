"""Feeds: the table behind each chart, as versions of a parquet table with a pointer to the current one.

A feed is a folder. Every write goes to a folder of its own below it and is followed by a manifest (rows, files and their
sizes, schema). Only then the pointer, one small file, is renamed over the old one. A write that fails or dies at any point
leaves the pointer, and with it the last whole feed, as it was; what it left behind is in no manifest and goes with a later write.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"
KEPT = 2


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    stream = _fs(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _rename_over(spark: SparkSession, src: str, dst: str) -> None:
    """One step that readers see either before or after."""
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, dst).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, src), _path(spark, dst), options)


def _data_files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Name below ``folder`` and size of every data file."""
    fs, root = _fs(spark, folder), _path(spark, folder)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    found, each = {}, fs.listFiles(root, True)
    while each.hasNext():
        status = each.next()
        name = status.getPath().toUri().getPath().removeprefix(base)
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found[name] = status.getLen()
    return found


def current_version(spark: SparkSession, feed: str) -> dict | None:
    """The manifest that the pointer names; ``None`` where nothing has been written yet."""
    pointer = f"{feed}/{POINTER}"
    if not _fs(spark, pointer).exists(_path(spark, pointer)):
        return None
    return json.loads(_read_text(spark, f"{feed}/{_read_text(spark, pointer)}/_manifest"))


def write_feed(df: DataFrame, name: str, out_dir: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the new version of the feed ``out_dir``/``name`` and return the version's folder. That one never changes;
    ``read_feed`` follows the pointer instead."""
    spark, feed = df.sparkSession, f"{out_dir}/{name}"
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # names sort by time
    folder, seen = f"{feed}/{version}", Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    manifest = {"version": version, "rows": seen.get["rows"], "files": _data_files(spark, folder), "schema": df.schema.jsonValue()}
    _write_text(spark, f"{folder}/_manifest", json.dumps(manifest))
    _write_text(spark, f"{feed}/.{version}", version)
    _rename_over(spark, f"{feed}/.{version}", f"{feed}/{POINTER}")
    _drop_old(spark, feed, version)
    return folder


def _drop_old(spark: SparkSession, feed: str, version: str) -> None:
    """Delete versions before the last ``KEPT``: readers of the one before may still be at work. Younger ones may be a write
    that is under way and are left alone."""
    fs = _fs(spark, feed)
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, feed))]
    whole = sorted(n for n in names if n.startswith("v") and n <= version and fs.exists(_path(spark, f"{feed}/{n}/_manifest")))
    oldest = whole[-KEPT:][0]
    for n in names:
        if n.removeprefix(".").startswith("v") and n.removeprefix(".") < oldest:
            fs.delete(_path(spark, f"{feed}/{n}"), True)


def read_feed(spark: SparkSession, feed: str) -> DataFrame:
    """The current version of a feed. A data file that is missing or of another size than in the manifest is an error."""
    manifest = current_version(spark, feed)
    if manifest is None:
        raise FileNotFoundError(f"no version of {feed} has been completed")
    from pyspark.sql.types import StructType

    folder = f"{feed}/{manifest['version']}"
    held = _data_files(spark, folder)
    if odd := {n for n, size in manifest["files"].items() if held.get(n) != size}:
        raise OSError(f"{len(odd)} files of {folder} are missing or not as written, among them {min(odd)}")
    return spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(folder)

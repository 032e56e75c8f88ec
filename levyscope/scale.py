"""Size checks and lineage cuts shared by the operators.

Two rules hold everywhere in the package:

* a table is broadcast, or a group handled inside one task, only when its row count has been measured, is at most
  ``SMALL_ROWS``, and its rows come to at most ``SMALL_BYTES``; otherwise an equally exact distributed form is used;
* a result that several branches read is written once as a parquet table below ``spark.checkpoint.dir`` and read back, so
  it is not recomputed, survives the loss of executors, and shows Catalyst its real size.
"""

from __future__ import annotations

import functools
import operator
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 1_000_000
SMALL_BYTES = 128 << 20
SALTS = 64

_local_root: dict[str, str] = {}


def is_small(rows: int | None, width: int = 100) -> bool:
    """True only for a measured row count within the limit, also if each row takes ``width`` bytes."""
    return rows is not None and rows <= SMALL_ROWS and rows * width <= SMALL_BYTES


@dataclass(frozen=True)
class Staged:
    """A written table and the number of rows counted while writing it."""

    df: DataFrame
    rows: int
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def small(self) -> bool:
        return is_small(self.rows)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as named by the cluster in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="levyscope-")
    return _local_root[app]


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/levyscope/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", **counts: Column) -> Staged:
    """Write ``df`` once and read it back; the rows, and the rows meeting each named condition, are counted on the way."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    seen = Observation()
    extra = [F.count_if(cond).alias(name) for name, cond in counts.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *extra).write.parquet(path)
    found = dict(seen.get)
    return Staged(spark.read.schema(df.schema).parquet(path), found.pop("rows"), found)


def release(spark: SparkSession) -> None:
    """Delete what this application has written below the checkpoint folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_root(spark)}/levyscope/{spark.sparkContext.applicationId}"
    )
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, the number its own broadcast rule looks at."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def settle(df: DataFrame, label: str = "side", fan_out: int = 1) -> DataFrame:
    """Prepare the smaller side of a large join.

    Below Catalyst's own broadcast limit the frame is returned as it is and will be broadcast. Above it, the side is
    written out first: a join of two plain scans has an exchange directly below each sort, the only shape in which
    adaptive execution can split a hot key of the larger side. ``fan_out`` bounds the rows an ``explode`` in ``df`` makes of
    one, which the estimate does not see.
    """
    if fan_out * planned_bytes(df) <= broadcast_limit(df.sparkSession):
        return df
    return stage(df, label).df


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    """Join condition in which a missing key equals a missing key."""
    return functools.reduce(operator.and_, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the left key columns are kept."""
    held = {k: f"__{k}" for k in keys}
    right = right.withColumnsRenamed(held)
    cond = same(left, right, list(held.items()))
    return left.join(F.broadcast(right) if small else right, cond, how).drop(*held.values())


def row_hash(df: DataFrame) -> Column:
    """Hash of a row's own values: a salt or tie that is the same whenever and wherever the row is computed again.

    A row number would not do: the order of rows after an exchange may differ when a lost task runs anew.
    """
    return F.xxhash64(*[name for name, kind in df.dtypes if "map<" not in kind])


def attach_groups(df: DataFrame, stats: DataFrame, by: list[str], rows: int | None = None, width: int = 100) -> DataFrame:
    """Join one-row-per-group ``stats`` back to the rows of ``df``.

    ``rows`` is a measured count that bounds the rows of ``stats``, ``width`` bounds the bytes of one of them. Without a count
    (or above the limits) the table is written and counted: a counted small table is broadcast, a large one is joined on group
    and salt, so that a group holding a large part of the rows is spread over ``SALTS`` tasks. Wide rows are not copied for
    every salt: written tables on both sides are joined as they are, and adaptive execution splits a hot group.
    """
    if is_small(rows, width):
        return join_null_safe(df, stats, by, small=True)
    counted = stage(stats, "groups")
    if is_small(counted.rows, width):
        return join_null_safe(df, counted.df, by, small=True)
    if width > 1000:
        return join_null_safe(df, counted.df, by)
    salted = df.withColumn("__salt", F.pmod(row_hash(df), F.lit(SALTS)).cast("int"))
    copies = counted.df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_null_safe(salted, copies, [*by, "__salt"]).drop("__salt")

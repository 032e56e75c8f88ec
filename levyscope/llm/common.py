"""What several corpus operators share: reading tables, row ids, and batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscope.scale import stage

#: ASCII white space, the only characters that end a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of a document table, whatever else it carries."""
    return docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))


def rows(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``step`` rows and about four million characters, so that one slice of long texts
    stays small next to the memory of a task. A single longer row is a slice of its own."""
    release_memory()  # of an earlier task in this worker
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(step, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > 4_000_000:
                n //= 2
            yield batch.slice(start, n)
            start += n


def release_memory() -> None:
    """Give freed memory back to the system: a worker outlives its task, and its executor has other work for it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: read many times, computed once, safe from lost executors."""
    return stage(df, label).df


def unlike(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

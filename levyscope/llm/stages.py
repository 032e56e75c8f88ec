"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscope.llm.common import unlike
from levyscope.llm.packing import pack_documents
from levyscope.llm.quality import kept_documents
from levyscope.llm.queries import vocabulary_path
from levyscope.llm.secrets import redacted_documents
from levyscope.llm.simhash import first_of_each
from levyscope.llm.suffixes import remove_repeats
from levyscope.scale import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits. Rows without ``doc_id`` and repeated rows are
    judged like any other."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints (shingles of three words) links of at most three bits connect."""
    return first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place holds. What removal leaves of a character goes too; a null text
    becomes empty. If a ``doc_id`` is missing or repeated, rows are numbered in the order of ``doc_id`` (missing: last)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b.decode("utf-8", "ignore") for b in batch.column("kept_bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "text"])

    place, base = unlike(docs, "place"), docs
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        base = base.withColumn(place, F.col("doc_id").cast("long"))
    else:
        ordered = base.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
        base = stage(ordered.withColumn(place, F.monotonically_increasing_id()), "numbered-rows").df
    found = remove_repeats(base.select(F.col(place).alias("doc_id"), "text"), with_bytes=True).select("doc_id", "kept_bytes")
    left = found.mapInArrow(decode, "doc_id long, text string").select(F.col("doc_id").alias(place), "text")
    out = base.drop("text").join(left, place)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark; null and empty texts, repeated rows and rows without ``doc_id`` stay as they
    are."""
    return redacted_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens. A null or empty text is one piece, the end
    id; repeated rows and rows without ``doc_id`` are packed as documents of their own."""
    return pack_documents(docs, vocabulary_path())

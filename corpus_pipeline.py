"""A corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from levyscope.llm import stages
from levyscope.scale import stage

STAGES = [
    ("quality_rules", stages.quality),
    ("simhash_near_dedup", stages.near_duplicates),
    ("suffix_array_dedup", stages.repeated_passages),
    ("secret_scan", stages.secrets),
    ("best_fit_packing", stages.packing),
]

#: SQL cannot express fingerprints, byte removal or tokenisation; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as parquet and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs

"""Table readers: parquet, SQL extract, CSV ingest, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet table under a declared schema."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_extract(spark: SparkSession, src, cols: list[str], where: str | None = None) -> DataFrame:
    """Selected columns under a predicate.

    ``src`` is a parquet path, or a dict of JDBC options (``url``, ``dbtable``, and for a parallel read
    ``partitionColumn`` / ``lowerBound`` / ``upperBound`` / ``numPartitions``). The column list and the predicate are
    plain DataFrame operations: Catalyst pushes both into the scan, for parquet and for JDBC.
    """
    df = spark.read.format("jdbc").options(**src).load() if isinstance(src, dict) else spark.read.parquet(src)
    df = df if where is None else df.where(where)
    return df.select(*cols)


def ingest_csv(spark: SparkSession, src: str, dst: str, schema: str) -> DataFrame:
    """CSV with a header line to a parquet table; returns the table."""
    spark.read.schema(schema).option("header", True).csv(src).write.mode("errorifexists").parquet(dst)
    return spark.read.schema(schema).parquet(dst)


def read_long(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Long extract, one row per (area, variable) with its denominator."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def rings_of(polygons: DataFrame) -> Column:
    """The rings of each polygon, whether it has one (``ring``) or several (``rings``)."""
    return F.col("rings") if "rings" in polygons.columns else F.array("ring")


def with_bounds(polygons: DataFrame) -> DataFrame:
    """Bounding box of each polygon as four columns."""
    points = F.flatten(rings_of(polygons))

    def axis(name):
        return F.transform(points, lambda p: p[name])

    return polygons.withColumns(
        {
            "xmin": F.array_min(axis("x")),
            "xmax": F.array_max(axis("x")),
            "ymin": F.array_min(axis("y")),
            "ymax": F.array_max(axis("y")),
        }
    )


def read_polygons(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Polygon layer (geoid, ring or rings) with bounding boxes."""
    return with_bounds(spark.read.schema(schema).parquet(path))

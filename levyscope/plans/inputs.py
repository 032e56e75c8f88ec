"""The study's input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from levyscope.sources import schemas
from levyscope.sources.literals import price_index
from levyscope.sources.readers import read_long, read_polygons, read_table


TABLES = (
    "sales",
    "assessments",
    "class_dict",
    "townships",
    "appeals",
    "prices",
    "acs_race",
    "block_groups",
    "pin_points",
)


class Inputs:
    """The tables of the study as attributes, each given by a function and built on first use."""

    def __init__(self, **builders: Callable[[], DataFrame]):
        unknown = set(builders) - set(TABLES)
        if unknown:
            raise TypeError(f"not a table of the study: {sorted(unknown)}")
        self._builders = builders

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        df = self._builders[name]()
        setattr(self, name, df)
        return df


def load_inputs(spark: SparkSession, folder: str) -> Inputs:
    """Parquet tables named as in ``Inputs`` below one folder; the price index is the built-in one."""
    return Inputs(
        sales=lambda: read_table(spark, f"{folder}/sales", schemas.SALES),
        assessments=lambda: read_table(spark, f"{folder}/assessments", schemas.ASSESSMENTS),
        class_dict=lambda: read_table(spark, f"{folder}/class_dict", schemas.CLASS_DICT),
        townships=lambda: read_table(spark, f"{folder}/townships", schemas.TOWNSHIPS),
        appeals=lambda: read_table(spark, f"{folder}/appeals", schemas.APPEALS),
        prices=lambda: price_index(spark),
        acs_race=lambda: read_long(spark, f"{folder}/acs_race", schemas.ACS_LONG),
        block_groups=lambda: read_polygons(spark, f"{folder}/block_groups", schemas.POLYGONS).drop("xmin", "xmax", "ymin", "ymax"),
        pin_points=lambda: read_table(spark, f"{folder}/pin_points", schemas.POINTS),
    )

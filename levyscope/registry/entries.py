"""One entry per operator and pipeline: the Spark query and the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscope.plans.study import Study
from levyscope.registry import fixtures
from levyscope.registry.oracle import with_tables


class Context:
    """Inputs and study of one query run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cached_property
    def inputs(self):
        return fixtures.inputs(self.spark, self.sf_dir)

    @functools.cached_property
    def study(self) -> Study:
        return Study(self.inputs, fixtures.BASE_YEAR)

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def tiles(self) -> DataFrame:
        return fixtures.label_tiles(self.spark, self.sf_dir)


def nudge(places: int) -> float:
    """Small shift ahead of rounding: means of cents often end in an exact half, which the last bit would decide."""
    return 0.137 * 10.0**-places


@dataclass(frozen=True)
class Entry:
    build: Callable[[Context], DataFrame]
    sql: str | None
    places: dict[str, int] = field(default_factory=dict)
    regions: bool = False

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Result with the named doubles rounded, as sums in another order differ in the last bits."""
        df = self.build(Context(spark, sf_dir))
        rounded = {c: F.round(F.col(c) + F.lit(nudge(p)), p) for c, p in self.places.items()}
        return df.withColumns(rounded) if rounded else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        text = self.sql
        if self.places:
            rounded = (f"round({c} + {nudge(p)!r}::DOUBLE, {p}) AS {c}" for c, p in self.places.items())
            text = f"SELECT * REPLACE ({', '.join(rounded)}) FROM ({text})"
        return with_tables(text, self.regions)


ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None, places: str = "", regions: bool = False):
    """Register a query. ``places`` is 'column:digits column:digits'."""
    digits = {c: int(p) for c, p in (part.split(":") for part in places.split())}

    def register(build):
        if name in ENTRIES:
            raise ValueError(name)
        ENTRIES[name] = Entry(build, sql, digits, regions)
        return build

    return register

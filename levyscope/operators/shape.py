"""Column naming, templated columns, and wide/long reshaping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def clean_names(df: DataFrame) -> DataFrame:
    """Runs of white space, dots and slashes in column names become one underscore each."""
    return df.toDF(*[re.sub(r"\s+|\.|/", "_", c) for c in df.columns])


def adjust(df: DataFrame, cols: list[str], factors: list[str]) -> DataFrame:
    """``{col}_{factor}`` = col * factor for every pair."""
    return df.withColumns({f"{c}_{f}": F.col(c) * F.col(f) for f in factors for c in cols})


def relabel(c: Column, labels: dict, default: str | None = None) -> Column:
    """Searched CASE over equality; without a default an unlisted value becomes NULL."""
    first, *rest = labels.items()
    out = F.when(c == first[0], F.lit(first[1]))
    for value, text in rest:
        out = out.when(c == value, F.lit(text))
    return out if default is None else out.otherwise(F.lit(default))


def ordered_category(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """Keep only the listed levels (others become NULL) and add their 1-based order as ``{col}_ord``."""
    order = F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)).cast("int"), F.lit(0))
    return df.withColumn(f"{col}_ord", order).withColumn(col, F.when(F.col(f"{col}_ord").isNotNull(), F.col(col)))


def unpivot_long(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    return df.unpivot(ids, cols, "name", "value")


def pivot_wide(df: DataFrame, ids: list[str], names_from: str, names: list[str], values: list[str]) -> DataFrame:
    """One row per ``ids``; columns ``{value}_{name}``. The category list is given, so no extra pass collects it.

    A conditional aggregate per cell keeps one partially aggregated shuffle on ``ids``, and lets a missing id be an id.
    A category outside the list ends the query with an error, as it would otherwise be lost.
    """
    name = F.col(names_from)
    lost = F.raise_error(F.concat(F.lit(f"{names_from} is none of the listed: "), F.coalesce(name.cast("string"), F.lit("NULL"))))
    listed = F.coalesce(name.isin(names), F.lit(False))
    cells = [F.max(F.when(name == n, F.col(v)).when(~listed, lost)).alias(f"{v}_{n}") for v in values for n in names]
    return df.groupBy(*ids).agg(*cells)

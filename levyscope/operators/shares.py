"""Group sums, counts, profiles, shares of a total and stacked bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.functions.scalars import ieee_div
from levyscope.functions.sums import sum_of
from levyscope.scale import attach_groups


def sum_by(df: DataFrame, keys: list[str], cols: list[str], strict: bool = True) -> DataFrame:
    """Sums of several columns in one partially aggregated pass; ``strict`` ones are NULL as soon as one input is."""
    return df.groupBy(*keys).agg(*[(_strict(df, c) if strict else sum_of(df, c)).alias(c) for c in cols])


def _strict(df: DataFrame, name: str) -> Column:
    return F.when(F.count(name) == F.count(F.lit(1)), sum_of(df, name))


def tally(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values (NULL or NaN) per column, all columns in one pass, as (column, n_null) rows."""

    def missing(name: str, kind: str) -> Column:
        c = F.col(name)
        gone = c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()
        return F.count_if(gone).alias(name)

    one = df.agg(*[missing(n, k) for n, k in df.dtypes])
    return one.unpivot([], df.columns, "column", "n_null")


def share_of_total(
    df: DataFrame, cols: list[str], by: list[str], rows: int | None = None, summary: bool = False
) -> DataFrame:
    """Totals per ``by`` (``{col}_sum``) and each row's share of them (``{col}_share``).

    The totals are a partial aggregate joined back rather than a window, so a large group is not drawn into one task. With
    ``summary`` (``df`` has one row per group already, and few per total) a window does it in one pass.
    """
    if summary:
        group = Window.partitionBy(*by)
        whole = F.count(F.lit(1)).over(group)
        out = df.withColumns({f"{c}_sum": F.when(F.count(c).over(group) == whole, sum_of(df, c, group)) for c in cols})
        return out.withColumns({f"{c}_share": ieee_div(F.col(c), F.col(f"{c}_sum")) for c in cols})
    totals = df.groupBy(*by).agg(*[_strict(df, c).alias(f"{c}_sum") for c in cols])
    out = attach_groups(df, totals, by, rows)
    return out.withColumns({f"{c}_share": ieee_div(F.col(c), F.col(f"{c}_sum")) for c in cols})


def stack(df: DataFrame, x: str, y: str, series: str, by: list[str]) -> DataFrame:
    """Lower and upper edge of every band of a stacked area; the last series lies at the bottom.

    Runs on summaries: a window group is one (facet, x) with one row per series.
    """
    pile = Window.partitionBy(*by, x).orderBy(F.col(series).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("upper", F.sum(y).over(pile)).withColumn("lower", F.col("upper") - F.col(y))

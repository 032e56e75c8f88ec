"""Ratio statistics: dispersion (COD), price-related differential (PRD) and price-related bias (PRB)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.functions.scalars import ieee_div, is_number, mean_of_numbers, nan_as_missing, strict_mean, strict_sum, t_quantile, weighted_mean
from levyscope.operators.outliers import group_median, with_quantiles
from levyscope.scale import is_small, join_null_safe


def with_median(df: DataFrame, value: str, by: list[str], name: str, rows: int | None = None) -> DataFrame:
    """Group median on every row."""
    return with_quantiles(df, value, by, {name: 0.5}, rows)


def cod(df: DataFrame, ratio: str, by: list[str], rows: int | None = None) -> DataFrame:
    """Mean absolute deviation from the median over the median, and the count."""
    dev = with_median(df, ratio, by, "__med", rows)
    return (
        dev.groupBy(*by)
        .agg(
            strict_sum(F.abs(F.col(ratio) - F.col("__med"))).alias("__dev"),
            F.first("__med").alias("__med"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(*by, ieee_div(F.col("__dev") / F.col("n"), F.col("__med")).alias("cod"), "n")
    )


def prd(df: DataFrame, ratio: str, price: str, by: list[str], rows: int | None = None) -> DataFrame:
    """Mean ratio over price-weighted mean ratio, with its parts. A small measured table gets its median in the same pass."""
    parts = {
        "mean_av": mean_of_numbers(F.col(ratio)),
        "weighted_mean_av": weighted_mean(F.col(ratio), F.col(price)),
        "n": F.count(F.lit(1)),
    }
    if is_small(rows):
        parts["median_av"] = F.median(nan_as_missing(F.col(ratio)))
    out = df.groupBy(*by).agg(*[c.alias(name) for name, c in parts.items()])
    if "median_av" not in parts:
        out = join_null_safe(out, group_median(df, ratio, by, "median_av"), by)
    prd = ieee_div(F.col("mean_av"), F.col("weighted_mean_av"))
    return out.select(*by, "mean_av", "median_av", "weighted_mean_av", prd.alias("prd"), "n")


def prb_terms(df: DataFrame, ratio: str, av: str, price: str, by: list[str], rows: int | None = None) -> DataFrame:
    """Regression terms of the price-related bias: log2 of the value proxy and the relative ratio deviation."""
    dev = with_median(df, ratio, by, "__med", rows)
    proxy = 0.5 * ieee_div(F.col(av), F.col("__med")) + 0.5 * F.col(price)
    return dev.select(
        *by,
        ieee_div(F.col(ratio) - F.col("__med"), F.col("__med")).alias("prb_pct_diff"),
        F.log2(proxy).alias("prb_ln_value"),
    )


def ols_by(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Least-squares line of y on x per group."""
    return df.groupBy(*by).agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope")
    )


def ols_interval(
    df: DataFrame, y: str, x: str, by: list[str], level: float = 0.99, pool: bool = True
) -> DataFrame:
    """Line per group with a confidence interval of its slope.

    ``pool`` uses one residual variance and its degrees of freedom for all groups, otherwise each group has its own: a group
    of three rows has one degree of freedom, one of two rows no interval. Everything comes from one pass of mergeable moments.
    """
    moments = df.groupBy(*by).agg(
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("est"),
        F.regr_sxx(y, x).alias("__sxx"),
        F.regr_syy(y, x).alias("__syy"),
        F.regr_sxy(y, x).alias("__sxy"),
        F.regr_count(y, x).alias("n"),
    )
    # a residual sum can come out a hair below zero on an exact line
    rss = F.greatest(F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.nullif(F.col("__sxx"), F.lit(0.0)), F.lit(0.0))
    fits = moments.withColumn("__rss", rss).withColumn("__df", F.greatest(F.col("n") - 2, F.lit(0)))
    if pool:
        # partial sums of the groups' rows; the moments' exchange is the same in both branches, so it is made once
        whole = fits.agg(F.sum("__rss").alias("__s"), F.sum("__df").alias("__d"))
        fits = fits.crossJoin(F.broadcast(whole))  # one row
    else:
        fits = fits.withColumns({"__s": F.col("__rss"), "__d": F.col("__df")})
    free = F.nullif(F.col("__d").cast("double"), F.lit(0.0))
    half = t_quantile(1 - (1 - level) / 2, free) * F.sqrt(F.col("__s") / free / F.nullif(F.col("__sxx"), F.lit(0.0)))
    return fits.withColumn("__half", half).select(
        *by,
        "intercept",
        "est",
        (F.col("est") - F.col("__half")).alias("lower"),
        (F.col("est") + F.col("__half")).alias("upper"),
        "n",
    )


# Target range of each statistic
TARGETS = {"cod": (0.05, 0.15), "prd": (0.98, 1.03), "prb": (-0.05, 0.05)}


def classify(df: DataFrame, col: str, lo: float, hi: float, name: str = "band") -> DataFrame:
    """below / within / above a target range; NULL for a missing statistic."""
    v = F.col(col)
    band = F.when(v < lo, F.lit("below")).when(v <= hi, F.lit("within")).otherwise(F.lit("above"))
    return df.withColumn(name, F.when(is_number(v), band))


def mean_by(df: DataFrame, keys: list[str], cols: list[str], also: list | None = None) -> DataFrame:
    """Row count and strict means of several columns in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), *(also or []), *[strict_mean(F.col(c)).alias(c) for c in cols]
    )

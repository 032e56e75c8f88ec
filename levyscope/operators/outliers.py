"""Exact group quantiles and the flags built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscope.functions.scalars import above, below, is_number
from levyscope.operators.rank import order_statistics
from levyscope.scale import attach_groups, is_small


def group_quantiles(
    df: DataFrame, value: str, by: list[str], probs: dict[str, float], rows: int | None = None
) -> DataFrame:
    """Exact interpolated (type 7) quantiles of ``value`` per group, one column per entry of ``probs``.

    NULL and NaN are left out. ``rows`` is the measured row count of ``df`` (it bounds both the size and the number of
    groups), None if it was not measured. ``percentile`` keeps every distinct value of a group in one task, so it is used only when
    the count is small; otherwise the wanted order statistics are narrowed down by ``order_statistics``.
    """
    valid = df.where(is_number(F.col(value))).select(*by, value)
    if is_small(rows):
        points = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()]))
        cut = valid.groupBy(*by).agg(points.alias("__q"))
        return cut.select(*by, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)])
    last = F.col("_n") - 1
    places = {name: last * F.lit(p) for name, p in probs.items()}
    wanted = [f(pos) for pos in places.values() for f in (F.floor, F.ceil)]
    found = order_statistics(valid, value, by, wanted)

    def between(i, name):
        lo, hi = F.col(f"__o{2 * i}"), F.col(f"__o{2 * i + 1}")
        share = places[name] - F.floor(places[name])
        return F.when(lo == hi, lo).otherwise((1 - share) * lo + share * hi).alias(name)

    return found.select(*by, *[between(i, name) for i, name in enumerate(probs)])


def group_median(df: DataFrame, value: str, by: list[str], name: str, rows: int | None = None) -> DataFrame:
    return group_quantiles(df, value, by, {name: 0.5}, rows)


TRIMS = [0.01, 0.02, 0.03, 0.04, 0.05]
NO_TRIMS: list[float] = []


def trim_names(p: float) -> tuple[str, str, str]:
    n = round(p * 100)
    return f"__p{n}", f"__p{100 - n}", f"av_ratio_{n}_to_{100 - n}"


def with_quantiles(
    df: DataFrame, value: str, by: list[str], probs: dict[str, float], rows: int | None = None
) -> DataFrame:
    """Group quantiles on every row. A small measured table takes one window pass, others the table of group quantiles."""
    if is_small(rows):
        points = F.percentile(F.nanvl(F.col(value), F.lit(None).cast("double")), F.array(*[F.lit(p) for p in probs.values()]))
        cut = df.withColumn("__q", points.over(Window.partitionBy(*by)))
        return cut.withColumns({name: F.col("__q")[i] for i, name in enumerate(probs)}).drop("__q")
    return attach_groups(df, group_quantiles(df, value, by, probs), by)


def ratio_flags(
    df: DataFrame,
    value: str,
    by: list[str],
    rows: int | None = None,
    fence: float | None = 1.5,
    trims: list[float] = TRIMS,
) -> DataFrame:
    """Fence flag (1 = strictly inside the quartile fences) and one trim flag per tail share (0 = in a tail).

    All cut points come from one quantile pass. A missing value is never inside the fences and never in a tail.
    """
    probs = {"__q1": 0.25, "__q3": 0.75} if fence is not None else {}
    for p in trims:
        lo, hi, _ = trim_names(p)
        probs |= {lo: p, hi: 1 - p}
    df = with_quantiles(df, value, by, probs, rows)
    v = F.col(value)
    flags = {}
    if fence is not None:
        spread = (F.col("__q3") - F.col("__q1")) * fence
        inside = above(v, F.col("__q1") - spread) & below(v, F.col("__q3") + spread)
        flags["outlier_flag_iaao"] = inside.cast("int")
    for p in trims:
        lo, hi, name = trim_names(p)
        flags[name] = (~(below(v, F.col(lo)) | above(v, F.col(hi)))).cast("int")
    return df.withColumns(flags).drop(*probs)


def iqr_flag(df: DataFrame, value: str, by: list[str], rows: int | None = None, k: float = 1.5) -> DataFrame:
    return ratio_flags(df, value, by, rows, fence=k, trims=[])


def trim_flags(df: DataFrame, value: str, by: list[str], rows: int | None = None) -> DataFrame:
    return ratio_flags(df, value, by, rows, fence=None)


def zscore_by_group(
    df: DataFrame, value: str, by: list[str], name: str = "zscore", rows: int | None = None
) -> DataFrame:
    """abs((x - mean) / sd) within the group, sample sd. Only a small measured table is put through a window."""
    x = F.col(value)
    stats = {"__mean": F.avg(x), "__sd": F.stddev_samp(x), "__given": F.count(x), "__all": F.count(F.lit(1))}
    if is_small(rows):
        group = Window.partitionBy(*by)
        df = df.withColumns({n: c.over(group) for n, c in stats.items()})
    else:
        df = attach_groups(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), by)
    score = F.abs((x - F.col("__mean")) / F.nullif(F.col("__sd"), F.lit(0.0)))
    # one missing value leaves the group's mean, and so every score, missing
    return df.withColumn(name, F.when(F.col("__given") == F.col("__all"), score)).drop(*stats)

"""Sums of doubles that do not depend on the order of the rows.

A double is cut into its nearest whole number and what is left (both exact), and each part is added as a decimal: the whole
numbers without places, the rest with 25. Decimals add exactly in any order and in any partitioning, so a task that runs anew
or a join that deals the rows otherwise gives the same bits. A rest is rounded to 25 places by itself, which is less than a
double's last bit from 1e-9 on.

Values that no decimal holds (1e18 and more, NaN, infinity) and values closer to zero than 1e-12 are added as plain doubles
beside the decimals. A group may have 2e13 rows; beyond that the decimals may overflow, which is an error and no wrong sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

HIGH, LOW = 1e18, 1e-12


def exact_sum(c: Column, over: WindowSpec | None = None) -> Column:
    """Sum of the double ``c`` without NULLs (NULL if there are none), in a group or ``over`` a window."""

    def added(v: Column) -> Column:
        return v if over is None else v.over(over)

    x = c.cast("double")
    fits = ((F.abs(x) >= LOW) | (x == 0)) & (F.abs(x) < HIGH)
    near = F.rint(x)
    whole = added(F.sum(F.when(fits, near.cast("decimal(18,0)").cast("decimal(38,0)")))).cast("double")
    rest = added(F.sum(F.when(fits, (x - near).cast("decimal(38,25)")))).cast("double")
    plain = added(F.sum(F.when(~fits, x)))
    return F.coalesce(whole + rest + F.coalesce(plain, F.lit(0.0)), plain)


def exact_mean(c: Column, over: WindowSpec | None = None) -> Column:
    """Mean of ``c`` without NULLs from its ``exact_sum``."""
    given = F.count(c) if over is None else F.count(c).over(over)
    return exact_sum(c, over) / F.nullif(given, F.lit(0).cast("long"))


def sum_of(df, name: str, over: WindowSpec | None = None) -> Column:
    """Sum of a column of ``df``: whole numbers and decimals are exact as they are, doubles become so."""
    if dict(df.dtypes)[name] in ("double", "float"):
        return exact_sum(F.col(f"`{name}`"), over)
    total = F.sum(f"`{name}`")
    return total if over is None else total.over(over)

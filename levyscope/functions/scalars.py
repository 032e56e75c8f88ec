"""Scalar and aggregate expressions built from Spark functions.

The study's arithmetic distinguishes a missing value (NULL here) from NaN and infinity, lets a missing input make a sum or
mean missing, and rounds halves to even. Spark's defaults differ on each point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from levyscope.functions.sums import exact_mean, exact_sum

INF = float("inf")
NAN = float("nan")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with x/0 = +-inf and 0/0 = NaN; NULL if either side is NULL."""
    a = a.cast("double")
    at_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a == 0, F.lit(NAN))
    # NaN sorts above every number, so "a > 0" holds for it: keep it NaN
    at_zero = F.when(F.isnan(a), F.lit(NAN)).otherwise(at_zero)
    return F.when(b != 0, a / b).when(b == 0, at_zero)


def is_number(c: Column) -> Column:
    """True unless the value is NULL or NaN (never NULL itself)."""
    return c.isNotNull() & ~F.isnan(c)


def above(a: Column, b: Column) -> Column:
    """a > b, false when either is NULL or NaN."""
    return F.coalesce(is_number(a) & is_number(b) & (a > b), F.lit(False))


def below(a: Column, b: Column) -> Column:
    return above(b, a)


def _complete(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def strict_sum(c: Column) -> Column:
    """Sum of doubles that is NULL as soon as one input is NULL."""
    return F.when(_complete(c), exact_sum(c))


def strict_mean(c: Column) -> Column:
    return F.when(_complete(c), exact_mean(c))


def strict_sd(c: Column) -> Column:
    return F.when(_complete(c), F.stddev_samp(c))


def weighted_mean(x: Column, w: Column) -> Column:
    """NULL as soon as a value or a weight is missing."""
    return F.when(_complete(x * w), ieee_div(exact_sum(x * w), exact_sum(w)))


def nan_as_missing(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def mean_of_numbers(c: Column) -> Column:
    """Mean that leaves out NULL and NaN."""
    return exact_mean(nan_as_missing(c))


def pad_left(c: Column, width: int, fill: str = "0") -> Column:
    """Left pad to ``width``; longer text is left alone (``lpad`` would cut it)."""
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), fill)


def month_date(c: Column) -> Column:
    """'Mar 05 2018' or 'March 5 2018' to a timestamp; NULL when the text is not such a date.

    The pattern is chosen from the length of the month name: trying both would raise and catch an exception per row.
    """
    short = F.instr(c, " ") == 4
    return F.when(short, F.try_to_timestamp(c, F.lit("MMM d yyyy"))).otherwise(
        F.try_to_timestamp(c, F.lit("MMMM d yyyy"))
    )


def number_text(c: Column) -> Column:
    """Number as text without a trailing '.0'."""
    c = c.cast("double")
    return F.when((c % 1 == 0) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def class_code(c: Column) -> Column:
    """Numeric property class to its text code; long codes carry two extra digits."""
    return number_text(F.when(c >= 1000, c / 100).otherwise(c))


def paste(*parts: Column, sep: str = " ") -> Column:
    """Join text parts; a missing part becomes the text NA."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def safe_log10(x: Column) -> Column:
    """log10 with every non-finite result set to 0, then raised to at least 1."""
    v = F.log10(F.nanvl(x.cast("double"), F.lit(None).cast("double")))
    return F.greatest(F.coalesce(F.nullif(v, F.lit(INF)), F.lit(0.0)), F.lit(1.0))


def percent_label(v: Column) -> Column:
    """Whole percent as text; NaN% and Inf% for what is no number."""
    v = v.cast("double")
    odd = F.when(F.isnan(v), F.lit("NaN")).when(v == INF, F.lit("Inf")).when(v == -INF, F.lit("-Inf"))
    return F.concat(F.when(F.isnan(v) | (F.abs(v) == INF), odd).otherwise(number_text(F.bround(v * 100, 0))), F.lit("%"))


def signif(x: Column, digits: int = 2) -> Column:
    """Round to significant digits, halves to even."""
    place = F.floor(F.log10(F.abs(x))) - (digits - 1)
    up, down = F.pow(F.lit(10.0), place), F.pow(F.lit(10.0), -place)  # whole powers are exact, fractions are not
    whole = F.bround(F.when(place < 0, x * down).otherwise(x / up), 0)
    return F.when(x == 0, F.lit(0.0)).when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(
        F.when(place < 0, whole / down).otherwise(whole * up)
    )


def billions_label(v: Column) -> Column:
    return F.concat(F.lit("$"), number_text(signif(v / 1e9, 2)), F.lit("B"))


def squish(v: Column, lo: float, hi: float) -> Column:
    """Clamp finite values to [lo, hi]; NULL, NaN and infinite ones stay."""
    odd = F.isnan(v) | (F.abs(v) == INF)
    return F.when(odd, v).when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def censor(x: Column, y: Column, xlim: tuple[float, float], ylim: tuple[float, float]) -> Column:
    """Predicate: the point lies inside both axis ranges."""
    return x.between(*xlim) & y.between(*ylim)


def in_set(c: Column, values) -> Column:
    """Set membership that is false, not NULL, for a missing value."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


#: From this many degrees of freedom on the series in 1/df is exact to ten digits.
SERIES_FROM = 200
ROOT_OF_PI = 1.7724538509055159


def _gamma_ratio(a: Column, shift: int = 16) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: an asymptotic series at a + shift, brought down by the recurrence."""
    down = F.aggregate(
        F.sequence(F.lit(0), F.lit(shift - 1)), F.lit(1.0), lambda t, j: t * (a + j.cast("double")) / (a + j.cast("double") + 0.5)
    )
    b = a + float(shift)
    series = 1 - 1 / (8 * b) + 1 / (128 * b * b) + 5 / (1024 * b * b * b) - 21 / (32768 * F.pow(b, F.lit(4.0)))
    return down * F.sqrt(b) * (series - 399 / (262144 * F.pow(b, F.lit(5.0))))


def _beta_fraction(a: Column, b: Column, x: Column, terms: int = 24) -> Column:
    """Continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2)."""

    def state(c, d, h):
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def turn(s, factor):
        d = 1 / (1 + factor * s["d"])
        c = 1 + factor / s["c"]
        return state(c, d, s["h"] * c * d)

    def step(s, k):
        m = k.cast("double")
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return turn(turn(s, even), odd)

    first = 1 / (1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), state(F.lit(1.0), first, first), step)["h"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value written, analysed and computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(t: Column, df: Column, scale: Column) -> Column:
    """``t_tail`` with the gamma ratio of df / 2 over the root of pi as ``scale``."""

    def of(v):
        a, x, direct, half = df / 2, v["x"], v["direct"], F.lit(0.5)
        one, other = F.when(direct, a).otherwise(half), F.when(direct, half).otherwise(a)
        fraction = _beta_fraction(one, other, F.when(direct, x).otherwise(1 - x))
        value = scale * F.pow(x, a) * F.sqrt(1 - x) * fraction
        return F.when(direct, value / df).otherwise(0.5 - value)

    x = df / (df + t * t)
    return let(F.struct(x.alias("x"), (x < (df + 2) / (df + 5)).alias("direct")), of)


def t_tail(t: Column, df: Column) -> Column:
    """Probability that a Student t variable with ``df`` degrees of freedom exceeds t > 0: half a regularised incomplete beta
    function, taken from the side on which its continued fraction converges."""
    return let(_gamma_ratio(df / 2) / ROOT_OF_PI, lambda scale: _tail(t, df, scale))


def t_quantile(p: float, df: Column) -> Column:
    """Student t quantile, to about ten digits for any positive ``df``; NULL for other ones.

    Closed forms for 1, 2 and 4 degrees of freedom; the normal quantile with four terms in 1/df from ``SERIES_FROM`` on; else
    Newton steps on the logarithm of the tail against the logarithm of t. That curve is concave, so from the normal
    quantile, which lies below, one step goes past the solution and all later ones come back towards it.
    """
    from math import cos, pi, sqrt, tan
    from statistics import NormalDist

    if p < 0.5:
        return -t_quantile(1 - p, df)
    if p == 0.5:
        return F.when(df > 0, F.lit(0.0))
    z, alpha = NormalDist().inv_cdf(p), 1 - p
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    free = df.cast("double")
    series = F.lit(z)
    for k, g in enumerate(terms, 1):
        series = series + F.lit(g) / F.pow(free, F.lit(float(k)))

    def solved(scale):
        def step(t, _):
            density = scale / F.sqrt(free) * F.pow(1 + t * t / free, -(free + 1) / 2)
            return let(_tail(t, free, scale), lambda tail: t * F.exp(F.log(tail / alpha) * tail / (t * density)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(z), step)

    newton = let(_gamma_ratio(free / 2) / ROOT_OF_PI, solved)
    q = 4 * p * (1 - p)  # four degrees of freedom: the root of a cubic
    four = 2 * sqrt(cos(_third_of_arc(sqrt(q))) / sqrt(q) - 1)
    return (
        F.when(free == 1, F.lit(tan(pi * (p - 0.5))))
        .when(free == 2, F.lit((2 * p - 1) * sqrt(2 / q)))
        .when(free == 4, F.lit(four))
        .when(free >= SERIES_FROM, series)
        .when(free > 0, newton)
    )


def _third_of_arc(c: float) -> float:
    from math import acos

    return acos(c) / 3

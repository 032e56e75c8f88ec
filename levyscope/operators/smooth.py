"""Local regression (loess) of a weighted summary, evaluated on a grid."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.functions.scalars import is_number
from levyscope.operators.rank import ranked
from levyscope.scale import Staged, attach_groups, join_null_safe, stage


def _places(points: Staged, by: list[str], x: str, tie: list[str]) -> DataFrame:
    """0-based place of each point by x within its group, and the group's size."""
    if points.small:
        group = Window.partitionBy(*by)
        place = (F.row_number().over(group.orderBy(x, *tie)) - 1).cast("bigint")
        return points.df.withColumns({"_rank": place, "_n": F.count(F.lit(1)).over(group)})
    return ranked(points.df, by, [x, *tie])


def _solve_at_zero(s: dict[str, Column]) -> Column:
    """Intercept of a weighted quadratic fit in u from its moment sums (Cramer's rule on the 3x3 normal equations)."""

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(s["w0"], s["w1"], s["w2"], s["w1"], s["w2"], s["w3"], s["w2"], s["w3"], s["w4"])
    part = det(s["y0"], s["w1"], s["w2"], s["y1"], s["w2"], s["w3"], s["y2"], s["w3"], s["w4"])
    # u is scaled to [-1, 1]: a determinant this small against the weights means fewer than three separate points
    return F.when(whole > 1e-12 * s["w0"] * s["w0"] * s["w0"], part / whole)


#: Highest power of u in a tricube weight times u^4 (of a point), and times u^2 (of a point and its value).
W_POWERS, Y_POWERS = 13, 11


def _grid_value(g: str, n_grid: int) -> str:
    return f"(_lo + (_hi - _lo) * {g} / {n_grid - 1})"


def _bandwidths(points: DataFrame, ends: DataFrame, by: list[str], x: str, n_grid: int) -> DataFrame:
    """(by, _g, _x0, _h): the distance of every grid point to its k-th nearest point.

    The k nearest are k consecutive points by x. Of the runs of k consecutive points, those whose middle lies at or above the
    grid point reach farther up, the others farther down; the bandwidth is the least reach of either kind. Runs are first
    reduced to the least upper and the greatest lower end in each gap of the grid, one row per run going in.
    """
    far = points.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("_rank").alias("__rank"), F.col(x).alias("_xk"))
    key = F.col("_rank") + F.col("_k") - 1 == F.col("__rank")
    for c in by:
        key = key & F.col(c).eqNullSafe(F.col(f"__{c}"))
    runs = points.join(far, key, "inner").select(*by, "_lo", "_hi", F.col(x).alias("_x1"), "_xk")
    middle = (F.col("_x1") + F.col("_xk")) / 2
    step = (F.col("_hi") - F.col("_lo")) / (n_grid - 1)
    near = F.coalesce(F.floor((middle - F.col("_lo")) / F.nullif(step, F.lit(0.0))), F.lit(0))
    near = F.least(F.greatest(near, F.lit(0)), F.lit(n_grid - 1)).cast("int")
    runs = runs.withColumns({"_mid": middle, "_g": near})
    # the division may err by one: compare with the grid's own values
    up, at = (F.expr(f"{_grid_value(g, n_grid)} <= _mid") for g in ("(_g + 1)", "_g"))
    gap = F.when(up & (F.col("_g") < n_grid - 1), F.col("_g") + 1).when(~at & (F.col("_g") > 0), F.col("_g") - 1).otherwise(F.col("_g"))
    gaps = runs.withColumn("_g", gap).groupBy(*by, "_g").agg(F.min("_xk").alias("_up"), F.max("_x1").alias("_down"))

    grid = ends.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    grid = grid.select(*by, "_g", F.expr(_grid_value("_g", n_grid)).alias("_x0"))
    held = join_null_safe(grid, gaps, [*by, "_g"])
    order = Window.partitionBy(*by).orderBy("_g")
    up = F.min("_up").over(order.rowsBetween(0, Window.unboundedFollowing))
    down = F.max("_down").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return held.select(*by, "_g", "_x0", F.least(up - F.col("_x0"), F.col("_x0") - down).alias("_h"))


def _place_among(cuts: Column, x: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (at most ``most``) are not above x, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= x, at + s).otherwise(at)
    )


def _moments(points: DataFrame, nodes: DataFrame, by: list[str], x: str, y: str, w: str, n_grid: int, rows: int) -> DataFrame:
    """Power sums of the points between neighbouring cuts, where a cut is a grid point or one end of its bandwidth.

    Every point lies between two cuts and goes into one row of the aggregate: sums of w v^j and w y v^j, with v the place
    between the cuts from -1 to 1, so that no power loses digits to the size of x.
    """
    ends = F.array(F.col("_x0") - F.col("_h"), F.col("_x0"), F.col("_x0") + F.col("_h"))
    cuts = nodes.where("_h > 0").groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ends)))).alias("_cuts"))
    held = attach_groups(points.select(*by, x, y, w), cuts, by, rows, width=8 * 3 * n_grid + 100)
    held = held.withColumn("_at", _place_among(F.col("_cuts"), F.col(x).cast("double"), 3 * n_grid))
    low, high = F.get("_cuts", F.col("_at") - 1), F.get("_cuts", F.col("_at"))
    held = held.select(*by, x, y, w, low.alias("_from"), high.alias("_to")).where("_from IS NOT NULL AND _to IS NOT NULL")
    v = (F.col(x) - (F.col("_from") + F.col("_to")) / 2) / ((F.col("_to") - F.col("_from")) / 2)
    held = held.select(*by, "_from", "_to", v.alias("_v"), F.col(w).cast("double").alias("_w"), (F.col(w) * F.col(y)).alias("_y"))
    sums = [f"sum(_{c} * pow(_v, {k})) AS _{c}{k}" for c, most in (("w", W_POWERS), ("y", Y_POWERS)) for k in range(most + 1)]
    return held.groupBy(*by, "_from", "_to").agg(*map(F.expr, sums))


def _weighted_sums(moments: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """The ten sums of every grid point from the power sums within its bandwidth.

    On either side of a grid point the tricube weight is a polynomial in u: 1 - 3 s u^3 + 3 u^6 - s u^9, with s the sign of u.
    With u = d + r v, a power sum in u is a binomial sum of those in v.
    """
    met = join_null_safe(nodes.where("_h > 0"), moments, by, "inner")
    met = met.where("_from >= _x0 - _h AND _to <= _x0 + _h")
    met = met.withColumn("_s", F.when(F.col("_to") <= F.col("_x0"), F.lit(-1.0)).otherwise(F.lit(1.0)))
    centre, half = (F.col("_from") + F.col("_to")) / 2, (F.col("_to") - F.col("_from")) / 2
    met = met.withColumns({"_d1": (centre - F.col("_x0")) / F.col("_h"), "_r1": half / F.col("_h")})
    powers = [f"pow(_{c}1, {k}) AS _{c}{k}" for c in "dr" for k in (0, *range(2, W_POWERS + 1))]
    met = met.selectExpr("*", *powers)

    def power_sum(k: int, of: str) -> str:
        return " + ".join(f"{comb(k, j)}D * _d{k - j} * _r{j} * _{of}{j}" for j in range(k + 1))

    sums = [f"{power_sum(k, c)} AS _{t}{k}" for c, t, most in (("w", "t", W_POWERS), ("y", "z", Y_POWERS)) for k in range(most + 1)]
    met = met.selectExpr(*by, "_g", "_x0", "_s", *sums)

    def weighted(i: int, of: str) -> str:
        return f"sum(_{of}{i} - 3D * _s * _{of}{i + 3} + 3D * _{of}{i + 6} - _s * _{of}{i + 9})"

    sums = [f"{weighted(i, 't')} AS w{i}" for i in range(5)] + [f"{weighted(i, 'z')} AS y{i}" for i in range(3)]
    out = met.groupBy(*by, "_g", "_x0").agg(*[F.expr(s) for s in [*sums, "sum(_t0) AS _all"]])
    # points at the very ends of the bandwidth have no weight: a grid point with no other ones has no fit
    return out.where("w0 > 1e-12D * _all")


def loess_by(
    df: DataFrame,
    x: str,
    y: str,
    w: str,
    by: list[str],
    span: float = 0.75,
    n_grid: int = 80,
    tie: list[str] | None = None,
) -> DataFrame:
    """Direct local quadratic regression per group at ``n_grid`` equally spaced x values.

    The bandwidth at a grid point is the distance to its k-th nearest point, found from the ends of runs of k consecutive
    points. The fit is ten weighted sums per grid point, put together from power sums between at most 3 ``n_grid`` cuts. No
    point is repeated for each grid point: the two aggregates over the points take one row per point, and what is
    joined to the grid afterwards is a bounded number of rows per group.
    """
    tie = tie or [y, w]
    valid = df.where(is_number(F.col(x)) & is_number(F.col(y)))
    staged = stage(valid.select(*by, x, y, w, *[t for t in tie if t not in (y, w)]), "points")  # read five times below
    rows = staged.rows
    ends = staged.df.groupBy(*by).agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    points = attach_groups(_places(staged, by, x, tie), ends, by, rows)
    points = points.withColumn("_k", F.least(F.floor(F.col("_n") * span + 1e-5), F.col("_n")))
    nodes = _bandwidths(points, ends, by, x, n_grid).withColumn("_h", F.col("_h") * max(span, 1.0))
    nodes = stage(nodes, "bandwidths").df
    fit = _weighted_sums(_moments(staged.df, nodes, by, x, y, w, n_grid, rows), nodes, by)
    solved = _solve_at_zero({n: F.col(n) for n in [f"w{i}" for i in range(5)] + [f"y{i}" for i in range(3)]})
    return fit.select(*by, F.col("_g").alias("grid"), F.col("_x0").alias(x), solved.alias(y))

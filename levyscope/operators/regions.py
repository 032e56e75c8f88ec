"""Regions: neighbouring polygons of one category, their areas, and the areas kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscope.operators.graph import hooked
from levyscope.operators.spatial import area, cells, centre, edges_of, level_of
from levyscope.scale import stage
from levyscope.sources.readers import rings_of


#: Side of the lattice on which corners are compared: a tenth of a millimetre in degrees. Corners are whole multiples of it.
LATTICE = 1e-9
#: Most pieces in which a long edge looks for corners.
MOST_PIECES = 1024


def lattice_edges(polygons: DataFrame, keep: list[str]) -> DataFrame:
    """Edges of all rings between lattice points, (geoid, ax, ay, bx, by) as whole numbers, the lesser end first; edges of no
    length go. Corners that are meant to be the same must differ by far less than a step."""

    def whole(v):
        return F.round(v / LATTICE).cast("long")

    each = polygons.select("geoid", *keep, F.inline(edges_of(rings_of(polygons))))
    each = each.select("geoid", *keep, *[whole(F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by")])
    return each.where("ax <> bx OR ay <> by").select("geoid", *keep, *lesser_first("ax", "ay", "bx", "by"))


def lesser_first(px, py, qx, qy):
    """The ends of an edge as ax, ay, bx, by in order."""
    px, py, qx, qy = (F.col(c) if isinstance(c, str) else c for c in (px, py, qx, qy))
    flip = (px > qx) | ((px == qx) & (py > qy))
    pairs = {"ax": (px, qx), "ay": (py, qy), "bx": (qx, px), "by": (qy, py)}
    return [F.when(flip, q).otherwise(p).alias(name) for name, (p, q) in pairs.items()]


def _near_corners(edges: DataFrame, usual: float) -> DataFrame:
    """(ax, ay, bx, by, at, vx, vy) for every corner v that lies inside an edge; ``at`` orders the corners along it.

    Corners and edges meet on grid cells. An edge up to the ``usual`` size lies on the grid of its own size; a longer one is
    looked at in pieces of that size (``MOST_PIECES`` at most), so a long edge does not meet all corners of its surroundings.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.greatest(F.abs(dx), F.abs(dy)).cast("double")
    least = F.greatest(size / MOST_PIECES, F.least(size, F.lit(usual)))
    lines = edges.select("ax", "ay", "bx", "by").distinct()
    lines = lines.withColumns({"_level": level_of(least, 2.0), "_n": F.ceil(size / F.pow(F.lit(2.0), level_of(least, 2.0))).cast("int")})
    levels = lines.agg(F.collect_set("_level").alias("_levels"))  # one row, a few exponents
    piece = lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest("_n", F.lit(1)) - 1)))

    def reach(a, d, axis):
        ends = [F.col(a) + d * (F.col("_i") + k) / F.greatest("_n", F.lit(1)) for k in (0, 1)]
        # two steps of the lattice to each side: a corner beside the edge may lie in the next cell
        return F.explode(cells(F.least(*ends) - 2, F.greatest(*ends) + 2, F.col("_level"))).alias(axis)

    piece = piece.select("*", reach("ax", dx, "_cx")).select("*", reach("ay", dy, "_cy")).drop("_i", "_n").distinct()
    corners = edges.select(F.inline(F.array(*[F.struct(F.col(f"{e}x").alias("vx"), F.col(f"{e}y").alias("vy")) for e in "ab"]))).distinct()
    placed = corners.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    cell = F.pow(F.lit(2.0), F.col("_level"))
    placed = placed.withColumns({"_cx": F.floor(F.col("vx") / cell), "_cy": F.floor(F.col("vy") / cell)})
    met = piece.join(placed, ["_level", "_cx", "_cy"])
    # differences of lattice points are exact in doubles, and so far smaller than 2^53 that a product errs by a small part of a step
    ex, ey = dx.cast("double"), dy.cast("double")
    wx, wy = (F.col("vx") - F.col("ax")).cast("double"), (F.col("vy") - F.col("ay")).cast("double")
    # snapping moves the corner and the line by up to half a diagonal of the lattice each
    beside = F.abs(ex * wy - ey * wx) <= 1.5 * F.hypot(ex, ey)
    along = ex * wx + ey * wy
    inside = (along > 0) & (along < ex * ex + ey * ey)
    own = ((F.col("vx") == F.col("ax")) & (F.col("vy") == F.col("ay"))) | ((F.col("vx") == F.col("bx")) & (F.col("vy") == F.col("by")))
    return met.where(beside & inside & ~own).select("ax", "ay", "bx", "by", along.alias("at"), "vx", "vy")


def edge_pieces(polygons: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The edges of all polygons, split at every corner that lies on them: (geoid, keep, ax, ay, bx, by), the lesser end first.

    What two boundaries share is then the same piece in both, an exact key of four whole numbers, whatever the direction of
    the edges and wherever on the plane they lie.
    """
    keep = keep or []
    edges = stage(lattice_edges(polygons, keep), "lattice-edges").df
    long = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    usual = edges.agg(F.percentile_approx(long, 0.5)).first()[0] or 1
    line = ["ax", "ay", "bx", "by"]
    split = stage(_near_corners(edges, float(usual)).distinct(), "split-edges").df
    # the stops of an edge: its start, the corners on it, and its end through the next stop of the last one
    cut = split.select(*line).distinct()
    starts = cut.select(*line, F.lit(0.0).alias("at"), F.col("ax").alias("vx"), F.col("ay").alias("vy"))
    stops = split.select(*line, "at", "vx", "vy").unionByName(starts)
    order = Window.partitionBy(*line).orderBy("at", "vx", "vy")
    nx, ny = (F.coalesce(F.lead(v).over(order), F.col(e)) for v, e in (("vx", "bx"), ("vy", "by")))
    parts = stops.select(*line, F.col("vx").alias("px"), F.col("vy").alias("py"), nx.alias("qx"), ny.alias("qy"))
    whole = edges.join(parts, line, "left")
    ends = [F.coalesce(c, e) for c, e in zip(("px", "py", "qx", "qy"), line)]
    return whole.select("geoid", *keep, *lesser_first(*ends))


def shared_edges(polygons: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pairs of polygons (a < b) whose boundaries meet along a line, be it a part of an edge only."""
    keep = keep or []
    line = ["ax", "ay", "bx", "by"]
    pieces = stage(edge_pieces(polygons, keep).distinct(), "edge-pieces").df
    other = pieces.select(*line, *[F.col(c).alias(f"{c}_b") for c in ("geoid", *keep)])
    met = pieces.join(other, line).where(F.col("geoid") < F.col("geoid_b"))
    pairs = met.select(F.col("geoid").alias("a"), F.col("geoid_b").alias("b"), *[x for k in keep for x in (k, f"{k}_b")])
    return pairs.distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Connected groups of ``nodes`` (id) under ``links`` (a, b); ``cluster_id`` is the least id of the group."""
    moved = hooked(links.select("a", "b"))
    found = nodes.select("id").join(moved, "id", "left")
    return found.select("id", F.coalesce("root", "id").alias("cluster_id"))


def dissolve(polygons: DataFrame, category: str) -> DataFrame:
    """Every polygon with the connected same-category group it belongs to."""
    polygons = stage(polygons, "layer").df
    pairs = shared_edges(polygons, [category]).where(F.col(category) == F.col(f"{category}_b")).select("a", "b")
    groups = components(polygons.select(F.col("geoid").alias("id")), pairs)
    return polygons.join(groups.withColumnRenamed("id", "geoid"), "geoid")


def with_area(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("area", area(rings_of(polygons)))


def cluster_areas(clustered: DataFrame, category: str) -> DataFrame:
    """Area and centre (mean of member centres) of every cluster."""
    cx, cy = centre(rings_of(clustered))
    parts = clustered.select("cluster_id", category, area(rings_of(clustered)).alias("area"), cx.alias("cx"), cy.alias("cy"))
    return parts.groupBy("cluster_id", category).agg(
        F.sum("area").alias("area"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy")
    )


def area_filter(clusters: DataFrame, category: str, top: int = 2, min_share: float = 0.01) -> DataFrame:
    """Clusters among the ``top`` largest of their category or with at least ``min_share`` of all area.

    The two conditions are taken apart: the first is a group limit ahead of the shuffle, the second a plain filter, and
    no window has to rank every cluster of a category. At most top * categories + 1 / min_share rows remain.
    """
    clusters = stage(clusters, "clusters").df  # read three times below
    total = clusters.agg(F.sum("area").alias("_total"))
    shared = clusters.crossJoin(F.broadcast(total))  # exactly one row
    shared = shared.withColumn("area_share", F.col("area") / F.col("_total")).drop("_total")
    # compared in single precision: equal areas summed in another order must still tie
    order = Window.partitionBy(category).orderBy(F.col("area").cast("float").desc(), F.col("cluster_id"))
    largest = shared.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top).drop("_rn")
    return largest.unionByName(shared.where(F.col("area_share") >= min_share)).dropDuplicates(["cluster_id"])


#: Targets in a leaf of the quadtree, bits of a coordinate, and bits by which a search descends in a round.
LEAF = 16
BITS = 30
STEP = 2


def quadtree(targets: DataFrame, box: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Nodes and leaves of a tree over ``targets`` (target, tx, ty): a cell that holds more than ``LEAF`` targets is divided into
    ``4 ** STEP`` cells, down to ``2 ** -BITS`` of the ``box`` (least x, least y, side).

    Nodes are (level, cx, cy, leaf) with the box around their targets; ``leaf`` targets are (level, cx, cy, target, tx, ty). Counts
    are partial aggregates over the cells of all levels, so no cell is collected, however many targets it holds.
    """
    x0, y0, side = box
    unit = (1 << BITS) / side

    def code(c, least):
        return F.least(F.floor((F.col(c) - least) * unit), F.lit((1 << BITS) - 1))

    rounds = BITS // STEP
    coded = targets.withColumns({"_ix": code("tx", x0), "_iy": code("ty", y0)})
    each = coded.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    cell = [F.expr(f"shiftright({c}, ({rounds} - level) * {STEP})").alias(n) for c, n in (("_ix", "cx"), ("_iy", "cy"))]
    each = each.select("level", *cell, "target", "tx", "ty")
    bounds = [f("t" + a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    cells_ = stage(each.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), *bounds), "quadtree-cells").df
    full = cells_.where(F.col("n") > LEAF).select((F.col("level") + 1).alias("level"), F.col("cx").alias("_px"), F.col("cy").alias("_py"))
    parent = [F.shiftright(c, STEP).alias(p) for c, p in (("cx", "_px"), ("cy", "_py"))]
    nodes = cells_.select("*", *parent)
    nodes = nodes.where("level = 0").unionByName(nodes.join(full, ["level", "_px", "_py"], "left_semi"))
    leaf = (F.col("n") <= LEAF) | (F.col("level") == rounds)
    nodes = stage(nodes.withColumn("leaf", leaf), "quadtree").df
    held = each.join(nodes.where("leaf").select("level", "cx", "cy"), ["level", "cx", "cy"], "left_semi")
    return nodes, stage(held, "quadtree-leaves").df


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target) for every point (id, x, y): the nearest of ``targets`` (target, x, y), the least target among equals
    (distances are equal when they are so in single precision).

    A search down an adaptive quadtree. All points start at the root; in a round every (point, node) pair is replaced by the
    node's children, and a pair stays only if the nearest place of its box is no farther than the farthest place of the
    point's best box. Boxes are drawn around the targets of a cell, so a dense cluster is one box until a point is close to it,
    and a point keeps a few nodes a round, however the targets lie. The leaves that stay are compared target by target.
    A point without coordinates, or one where there are no targets, gets none. Each round writes what is left.
    """
    kind = targets.schema["target"].dataType
    numbers = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    # of several targets on one spot the least can be the nearest
    spots = targets.where(numbers).groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min("target").alias("target"))
    spots = stage(spots, "targets")
    left = stage(points.where(numbers).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    if not left.rows or not spots.rows:
        return left.df.select("id", F.lit(None).cast(kind).alias("target")).limit(0)
    x0, y0, x1, y1 = spots.df.agg(F.min("tx"), F.min("ty"), F.max("tx"), F.max("ty")).first()
    nodes, leaves = quadtree(spots.df, (x0, y0, max(x1 - x0, y1 - y0) * (1 + 1e-9) or 1.0))

    def apart(c, far):
        low, high = F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}")
        d = F.greatest(F.abs(low), F.abs(high)) if far else F.greatest(low, high, F.lit(0.0))
        return d * d

    def pruned(pairs):
        """Pairs that may hold the nearest target; the margin keeps what single precision calls equal."""
        best = F.min(apart("x", True) + apart("y", True)).over(Window.partitionBy("id"))
        near = apart("x", False) + apart("y", False)
        pairs = pairs.withColumns({"_best": best, "_near": near}).where(F.col("_near") <= F.col("_best") * (1 + 1e-6))
        return pairs.drop("_best", "_near")

    node = ["level", "cx", "cy", "leaf", "lox", "hix", "loy", "hiy"]
    root = nodes.where("level = 0").select(*node)
    at = stage(left.df.crossJoin(F.broadcast(root)), "search", inner=~F.col("leaf"))  # one row
    while at.counts["inner"]:
        down = at.df.where("NOT leaf").select("id", "x", "y", (F.col("level") + 1).alias("level"), F.col("cx").alias("_px"), F.col("cy").alias("_py"))
        below = down.join(nodes.select("_px", "_py", *node), ["level", "_px", "_py"]).select("id", "x", "y", *node)
        at = stage(pruned(at.df.where("leaf").unionByName(below)), "search", inner=~F.col("leaf"))
    met = at.df.select("id", "x", "y", "level", "cx", "cy").join(leaves, ["level", "cx", "cy"])
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    found = met.groupBy("id").agg(F.min(F.struct((dx * dx + dy * dy).cast("float").alias("d"), "target")).alias("best"))
    return found.select("id", F.col("best.target").alias("target"))


def assign_nearest(clustered: DataFrame, kept: DataFrame, category: str) -> DataFrame:
    """Each polygon's own cluster if kept, else the kept cluster with the nearest centre (ties by least id)."""
    clustered = stage(clustered, "clustered").df
    kept = stage(kept, "kept").df
    own = clustered.join(kept.select("cluster_id"), "cluster_id", "left_semi").select("geoid", "cluster_id", category)
    cx, cy = centre(rings_of(clustered))
    lost = clustered.join(kept.select("cluster_id"), "cluster_id", "left_anti")
    near = nearest(
        lost.select(F.col("geoid").alias("id"), cx.alias("x"), cy.alias("y")),
        kept.select(F.col("cluster_id").alias("target"), F.col("cx").alias("x"), F.col("cy").alias("y")),
    )
    moved = near.join(kept.select("cluster_id", category), F.col("target") == F.col("cluster_id"))
    return own.unionByName(moved.select(F.col("id").alias("geoid"), "cluster_id", category))


def redissolve(polygons: DataFrame, assigned: DataFrame, category: str) -> DataFrame:
    """Polygons under their assigned category, dissolved again, with a running number of the clusters of a category."""
    rings = polygons.select("geoid", rings_of(polygons).alias("rings"))
    again = stage(dissolve(rings.join(assigned.select("geoid", category), "geoid"), category).drop("rings"), "redissolved").df
    number = F.row_number().over(Window.partitionBy(category).orderBy("cluster_id"))
    return again.join(again.select("cluster_id", category).distinct().withColumn("cluster_no", number), ["cluster_id", category])

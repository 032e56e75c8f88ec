"""Points, polygons and the point-in-area join, with array functions (planar coordinates).

A ring is ``array<struct<x, y>>`` whose last point repeats the first. A polygon has one (``ring``) or several (``rings``:
parts and holes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscope.operators.rank import dedup_first
from levyscope.scale import settle
from levyscope.sources.readers import rings_of, with_bounds


def points_from_lonlat(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    return df.withColumns({"x": F.col(lon), "y": F.col(lat)}).drop(lon, lat)


def drop_geometry(df: DataFrame) -> DataFrame:
    return df.drop("ring", "rings", "x", "y", "xmin", "xmax", "ymin", "ymax")


def _edge_count(ring: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))


def _edge(ring: Column, i: Column):
    a, b = F.try_element_at(ring, i), F.try_element_at(ring, i + 1)
    return a["x"], a["y"], b["x"], b["y"]


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """Ring edges crossed by the ray from (x, y) to the right."""

    def step(total, i):
        x1, y1, x2, y2 = _edge(ring, i)
        cuts = ((y1 > y) != (y2 > y)) & (x < x1 + (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)))
        return total + F.coalesce(cuts.cast("int"), F.lit(0))

    return F.aggregate(_edge_count(ring), F.lit(0), step)


def on_boundary(x: Column, y: Column, ring: Column) -> Column:
    def touches(i):
        x1, y1, x2, y2 = _edge(ring, i)
        level = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
        within = x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
        return F.coalesce(level & within, F.lit(False))

    return F.exists(_edge_count(ring), touches)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside the ring: odd number of crossings and not on an edge."""
    return (crossings(x, y, ring) % 2 == 1) & ~on_boundary(x, y, ring)


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Same for several rings of one polygon; holes and parts share one parity count."""
    total = F.aggregate(rings, F.lit(0), lambda acc, ring: acc + crossings(x, y, ring))
    return (total % 2 == 1) & ~F.exists(rings, lambda ring: on_boundary(x, y, ring))


def cell_size(polygons: DataFrame) -> float:
    """Median polygon width: most polygons then share the finest grid."""
    width = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return with_bounds(polygons).agg(F.percentile_approx(width, 0.5)).first()[0]


def level_of(width: Column, least: float) -> Column:
    """Least power of two (its exponent) that is not below ``width`` nor ``least``: a cell of this size meets an interval
    of the width at most twice."""
    return F.ceil(F.log2(F.greatest(width, F.lit(least)))).cast("int")


def cells(low: Column, high: Column, level: Column) -> Column:
    """The one or two cells of a level that an interval meets."""
    size = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low / size), F.floor(high / size))


#: Edges that a slab of a polygon holds, about.
SLAB_EDGES = 8


def edges_of(rings: Column) -> Column:
    """All edges of a polygon as structs ax, ay, bx, by."""

    def of_ring(ring):
        def edge(i):
            a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
            return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

        return F.when(F.size(ring) > 1, F.transform(F.sequence(F.lit(1), F.size(ring) - 1), edge)).otherwise(F.array())

    return F.flatten(F.transform(rings, of_ring))


def slabbed(polygons: DataFrame) -> DataFrame:
    """Bounds of every polygon with ``_slabs``, the number of equal slabs its height is cut into, and its edges as ``_edges``.

    A slab count is chosen so that the edges, each repeated in the slabs it passes, come to at most twice their number: with
    m edges that go up and down the height T times in all, m / T slabs make T m / T repetitions, and at most m more.
    """
    held = with_bounds(polygons).withColumn("_edges", edges_of(rings_of(polygons)))
    height = F.col("ymax") - F.col("ymin")
    rise = F.aggregate("_edges", F.lit(0.0), lambda t, e: t + F.abs(e["by"] - e["ay"]))
    turns = F.greatest(rise / F.nullif(height, F.lit(0.0)), F.lit(SLAB_EDGES / 2.0))
    slabs = F.greatest(F.floor(F.size("_edges") / turns), F.lit(1)).cast("int")
    return held.withColumn("_slabs", F.coalesce(slabs, F.lit(1)))


def slab_of(y: Column) -> Column:
    """Number of the slab at height y; as a function of y it never falls, whatever the rounding."""
    place = F.floor((y - F.col("ymin")) / F.nullif(F.col("ymax") - F.col("ymin"), F.lit(0.0)) * F.col("_slabs"))
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.col("_slabs") - 1), F.lit(0)).cast("int")


def slab_edges(held: DataFrame) -> DataFrame:
    """(geoid, _slab, _edges): the edges that reach into each slab."""
    each = held.select("geoid", "ymin", "ymax", "_slabs", F.explode("_edges").alias("e"))
    low, high = F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by")
    spread = each.select("geoid", F.explode(F.sequence(slab_of(low), slab_of(high))).alias("_slab"), "e")
    return spread.groupBy("geoid", "_slab").agg(F.collect_list("e").alias("_edges"))


def edge_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Edges of a list that the ray from (x, y) to the right crosses."""

    def cut(e):
        across = (e["ay"] > y) != (e["by"] > y)
        return across & (x < e["ax"] + (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)))

    return F.size(F.filter(edges, lambda e: F.coalesce(cut(e), F.lit(False))))


def touches_edge(x: Column, y: Column, edges: Column) -> Column:
    def on(e):
        level = (e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])
        return level & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(
            F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
        )

    return F.exists(edges, lambda e: F.coalesce(on(e), F.lit(False)))


GEOMETRY = ("ring", "rings", "xmin", "xmax", "ymin", "ymax")


def box_tests(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points (x, y) with every polygon (geoid, ring or rings) whose box holds them, and ``within``: strictly inside.

    Every polygon lies on the grid of its own size, ``cell`` at least, where its box meets at most four cells, so one very
    wide area costs no more than a small one. A point is looked up on every grid in use: their number is that of the powers
    of two between the least and the greatest width. The join is an equality on level and cell and carries boxes only.

    A polygon's edges are cut into slabs of its height, and a point in its box meets the few edges of its own slab: all that
    a ray to the right can cross, and all that can touch it. No ring travels, an area with very many corners costs a point no
    more than a square does, and the points of a large area spread over its slabs. Both tables are broadcast when even a
    multiple of Catalyst's estimate is small; otherwise they are written first, so that adaptive execution splits a hot key
    (a square that holds most points has one slab).

    The other columns of the polygons are kept, their shapes are not. A point without coordinates is in no box.
    """
    held = slabbed(polygons)
    level = level_of(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), cell)
    others = [c for c in polygons.columns if c not in ("geoid", *GEOMETRY)]
    box = ["xmin", "xmax", "ymin", "ymax", "_slabs"]
    boxed = held.select("geoid", *others, *box, level.alias("_level"))
    levels = boxed.agg(F.collect_set("_level").alias("_levels"))  # one row; widths of doubles have few exponents
    tiles = boxed.withColumn("_cx", F.explode(cells(F.col("xmin"), F.col("xmax"), F.col("_level"))))
    tiles = settle(tiles.withColumn("_cy", F.explode(cells(F.col("ymin"), F.col("ymax"), F.col("_level")))), "tiles", fan_out=4)
    located = points.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    size = F.pow(F.lit(2.0), F.col("_level"))
    located = located.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    near = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    pairs = located.join(tiles, ["_level", "_cx", "_cy"], "inner").where(near).drop("_level", "_cx", "_cy")
    pairs = pairs.withColumn("_slab", slab_of(F.col("y"))).drop(*box)
    # an edge is four numbers in the ring's two, repeated at most twice
    met = pairs.join(settle(slab_edges(held), "slabs", fan_out=4), ["geoid", "_slab"])
    x, y, edges = F.col("x"), F.col("y"), F.col("_edges")
    within = (edge_crossings(x, y, edges) % 2 == 1) & ~touches_edge(x, y, edges)
    return met.select(*points.columns, "geoid", *others, within.alias("within"))


def join_within(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points joined to the polygons that hold them strictly inside, by ``box_tests``."""
    return box_tests(points, polygons, cell).where("within").drop("within")


def pin_to_area(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """One point per pin10, then the area it lies in."""
    single = dedup_first(points, ["pin10"], ["longitude", "latitude"])
    placed = join_within(points_from_lonlat(single), polygons.select("geoid", rings_of(polygons).alias("rings")), cell)
    return placed.where(F.col("geoid").isNotNull()).select("pin10", "geoid")


def ring_area(ring: Column) -> Column:
    """Planar area inside a ring (shoelace)."""

    def step(total, i):
        x1, y1, x2, y2 = _edge(ring, i)
        return total + (x1 * y2 - x2 * y1)

    return F.abs(F.aggregate(_edge_count(ring), F.lit(0.0), step)) / 2


def area(rings: Column) -> Column:
    """Planar area of a polygon given by its rings; a ring inside an odd number of the others is a hole."""

    def signed(ring, i):
        corner = ring[0]
        around = F.aggregate(
            F.sequence(F.lit(0), F.size(rings) - 1),
            F.lit(0),
            lambda n, j: n + F.when(j == i, 0).otherwise(crossings(corner["x"], corner["y"], rings[j]) % 2),
        )
        return F.when(around % 2 == 1, -ring_area(ring)).otherwise(ring_area(ring))

    one = F.size(rings) == 1
    return F.when(one, ring_area(rings[0])).otherwise(F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda t, v: t + v))


def centre(rings: Column) -> tuple[Column, Column]:
    """Mean of the distinct corners of all rings."""
    corners = F.flatten(F.transform(rings, lambda r: F.slice(r, F.lit(1), F.size(r) - 1)))

    def mean(axis):
        return F.aggregate(corners, F.lit(0.0), lambda t, p: t + p[axis]) / F.size(corners)

    return mean("x"), mean("y")

"""Point in area, shared edges, connected groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from levyscope.operators import regions, spatial

RING = "array<struct<x: double, y: double>>"
L_SHAPE = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
HOLE = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8), (0.2, 0.2)]


def square(x, y, side=1.0):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_inside_an_l_shape(spark):
    cases = [((0.5, 0.5), True), ((1.5, 0.5), True), ((1.5, 1.5), False), ((3.0, 0.5), False), ((0.5, 1.5), True),
             ((2.0, 0.5), False), ((0.0, 1.0), False), ((1.0, 1.5), False), ((0.5, 0.0), False)]
    df = spark.createDataFrame([(i, *p, L_SHAPE) for i, (p, _) in enumerate(cases)], f"i int, x double, y double, ring {RING}")
    out = df.select("i", spatial.inside(F.col("x"), F.col("y"), F.col("ring")).alias("in_")).orderBy("i").collect()
    assert [r.in_ for r in out] == [want for _, want in cases]


def test_holes_share_the_parity_count(spark):
    df = spark.createDataFrame([(0.5, 0.5, [L_SHAPE, HOLE]), (0.1, 0.1, [L_SHAPE, HOLE])], f"x double, y double, rings array<{RING}>")
    assert [r[0] for r in df.select(spatial.inside_rings(F.col("x"), F.col("y"), F.col("rings"))).collect()] == [False, True]


@pytest.mark.parametrize("cell", [0.3, 1.0, 7.0])
def test_join_within_against_brute_force(spark, cell):
    rnd = random.Random(6)
    layer = [(f"{i}{j}", square(float(i), float(j))) for i in range(5) for j in range(5) if (i, j) != (2, 2)]
    points = [(k, rnd.uniform(-1, 6), rnd.uniform(-1, 6)) for k in range(400)]
    polys = spark.createDataFrame(layer, f"geoid string, ring {RING}")
    pts = spark.createDataFrame(points, "id int, x double, y double")
    got = {(r.id, r.geoid) for r in spatial.join_within(pts, polys, cell).collect()}
    want = {(k, g) for k, x, y in points for g, r in layer if r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1]}
    assert got == want


def test_one_point_per_pin(spark):
    pts = spark.createDataFrame([("1", 0.6, 0.5), ("1", 0.5, 0.5), ("2", 9.0, 9.0)], "pin10 string, longitude double, latitude double")
    polys = spark.createDataFrame([("a", square(0.0, 0.0, 0.55)), ("b", square(0.55, 0.0))], f"geoid string, ring {RING}")
    assert [tuple(r) for r in spatial.pin_to_area(pts, polys, 0.5).collect()] == [("1", "a")]


def test_area_of_an_l_shape(spark):
    df = spark.createDataFrame([(L_SHAPE,)], f"ring {RING}")
    assert df.select(spatial.area(F.array("ring"))).first()[0] == 3.0


def brute_groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(7)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    loose = [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(45)]
    nodes = list(range(61)) + list(range(100, 140)) + list(range(200, 261))
    rnd.shuffle(nodes)
    out = regions.components(
        spark.createDataFrame([(n,) for n in nodes], "id int"), spark.createDataFrame(chain + star + loose, "a int, b int")
    )
    assert {r.id: r.cluster_id for r in out.collect()} == brute_groups(nodes, chain + star + loose)


def test_dissolve_keep_and_assign(spark):
    # two large blocks of one category each, and a lone cell of a third one beside the second
    cells = [(f"a{i}", "A", square(float(i), 0.0)) for i in range(60)] + [(f"b{i}", "B", square(float(i), 5.0)) for i in range(60)]
    cells += [("c", "C", square(60.0, 5.0)), ("c2", "C", square(70.0, 5.0)), ("c3", "C", square(80.0, 5.0))]
    layer = spark.createDataFrame(cells, f"geoid string, category string, ring {RING}")
    grouped = regions.dissolve(layer, "category")
    areas = regions.cluster_areas(grouped, "category")
    assert areas.count() == 5
    kept = regions.area_filter(areas, "category")
    assert {r.cluster_id for r in kept.collect()} == {"a0", "b0", "c", "c2"}  # c3 is third of its category and under 1%
    out = {r.geoid: (r.cluster_id, r.category) for r in regions.assign_nearest(grouped, kept, "category").collect()}
    assert out["a7"] == ("a0", "A") and out["c"] == ("c", "C") and out["c3"] == ("c2", "C")


def fringed(corners, radius=1.0):
    """A ring of many corners around the origin, every second one drawn in a little."""
    turn = [2 * math.pi * i / corners for i in range(corners)]
    ring = [(radius * (1 - 0.001 * (i % 2)) * math.cos(a), radius * (1 - 0.001 * (i % 2)) * math.sin(a)) for i, a in enumerate(turn)]
    return ring + ring[:1]


def winding(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            odd = not odd
    return odd


@pytest.mark.parametrize("form", ["small", "large"])
def test_an_area_of_many_corners_with_most_points(spark, request, form):
    """50,000 corners; nine points of ten in the one area; slabs stay short, repetitions few, and no ring travels."""
    if form == "large":
        request.getfixturevalue("distributed")
    ring = fringed(50_000)
    layer = spark.createDataFrame([("big", "x", ring), ("one", "y", square(1.0, 1.0)), ("two", "z", square(-3.0, 0.0, 0.5))], f"geoid string, kind string, ring {RING}")
    held = spatial.slabbed(layer)
    slabs = spatial.slab_edges(held).select("geoid", F.size("_edges").alias("n"))
    most, total = slabs.where("geoid = 'big'").agg(F.max("n"), F.sum("n")).first()
    assert most < 1000 and total < 2 * 50_000
    rnd = random.Random(5)
    points = [(i, rnd.uniform(-0.99, 0.99), rnd.uniform(-0.6, 0.6)) for i in range(900)]
    points += [(1000 + i, 0.9995 * math.cos(i), 0.9995 * math.sin(i)) for i in range(100)] + [(2000, 1.5, 1.5), (2001, -2.75, 0.25), (2002, 9.0, 9.0), (2003, None, 0.0)]
    pts = spark.createDataFrame(points, "id int, x double, y double")
    out = spatial.join_within(pts, layer, 1.0)
    assert out.columns == ["id", "x", "y", "geoid", "kind"]
    got = {(r.id, r.geoid) for r in out.collect()}
    near = [(k, x, y) for k, x, y in points[:1000]]
    want = {(k, "big") for k, x, y in near if math.hypot(x, y) < 0.9985 or math.hypot(x, y) < 1 and winding(x, y, ring)}
    assert got == want | {(2000, "one"), (2001, "two")}
    assert 800 < len(want) < 1000


def test_no_ring_in_the_exchanges_of_the_join(spark, distributed):
    from tests.test_plans import plan

    layer = spark.createDataFrame([("a", square(0.0, 0.0)), ("b", square(1.0, 0.0))], f"geoid string, ring {RING}")
    pts = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    text = plan(spatial.join_within(pts, layer, 1.0))
    assert "SortMergeJoin" in text
    assert not any("ring#" in line for line in text.splitlines() if "Exchange" in line or "Join" in line)


def test_within_is_told_for_every_box(spark):
    layer = spark.createDataFrame([("l", L_SHAPE), ("q", square(0.0, 0.0, 2.0))], f"geoid string, ring {RING}")
    pts = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (0.0, 1.0), (5.0, 5.0)], "x double, y double")
    got = {(r.x, r.y, r.geoid): r.within for r in spatial.box_tests(pts, layer, 1.0).collect()}
    assert got == {(0.5, 0.5, "l"): True, (0.5, 0.5, "q"): True, (1.5, 1.5, "l"): False, (1.5, 1.5, "q"): True, (0.0, 1.0, "l"): False, (0.0, 1.0, "q"): False}

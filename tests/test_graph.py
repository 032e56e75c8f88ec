"""Connected groups, partial edges, areas of parts and nearest targets against plain Python."""

import math
import random

import pytest

from levyscope.operators import graph, regions, spatial
from tests.test_spatial import RING, brute_groups, square

POINT = "x double, y double"


@pytest.mark.parametrize("order", ["in order", "largest first", "mixed"])
def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch, order):
    n = 3000
    nodes = {"in order": range(n), "largest first": [0, *range(n - 1, 0, -1)], "mixed": random.Random(2).sample(range(n), n)}[order]
    rounds, plain = [], graph.stage

    def counted(df, label="stage", **counts):
        rounds.append(label)
        return plain(df, label, **counts)

    monkeypatch.setattr(graph, "stage", counted)
    links = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    out = {r.id: r.root for r in graph.hooked(links).collect()}
    assert out == {i: 0 for i in range(1, n)}
    assert rounds.count("edges") - 1 <= 2 * math.log2(n) + 4


@pytest.mark.parametrize("few", [0, graph.FEW])
def test_random_graphs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(5, 5), (None, 4), (7, None)]
    out = {r.id: r.root for r in graph.hooked(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_groups(range(300), [(a, b) for a, b in links if a is not None and b is not None])
    assert out == {i: r for i, r in want.items() if i != r}
    assert graph.hooked(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_meet_along_a_part_or_at_a_slant(spark):
    layer = [("a", square(0.0, 0.0, 2.0)), ("b", square(2.0, 1.0)), ("c", square(2.0, 2.0)), ("d", square(5.0, 5.0)), ("far", square(-1000.0, -2000.0, 2000.0))]
    layer += [("t", [(0.0, 2.0), (2.0, 2.0), (0.0, 4.0), (0.0, 2.0)]), ("u", [(1.5, 2.5), (0.5, 3.5), (3.0, 5.0), (1.5, 2.5)])]
    layer += [("top", square(-500.0, 0.0, 500.0))]
    polys = spark.createDataFrame(layer, f"geoid string, ring {RING}")
    pairs = {(r.a, r.b) for r in regions.shared_edges(polys).collect()}
    assert pairs == {("a", "b"), ("a", "far"), ("a", "t"), ("a", "top"), ("b", "c"), ("far", "top"), ("t", "top"), ("t", "u")}


def test_parts_and_holes(spark):
    rings = [("ring", [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0), square(1.5, 1.5, 1.0)]), ("two", [square(10.0, 0.0), square(20.0, 0.0)])]
    rings += [("wide", [square(-1000.0, -1000.0, 2000.0)])]
    polys = spark.createDataFrame(rings, f"geoid string, rings array<{RING}>")
    areas = {r.geoid: r.area for r in regions.with_area(polys).collect()}
    assert areas == {"ring": 13.0, "two": 2.0, "wide": 4e6}
    points = [(0.5, 0.5, {"ring"}), (1.2, 1.2, set()), (2.0, 2.0, {"ring"}), (10.5, 0.5, {"two"}), (15.0, 0.5, set()), (20.5, 0.5, {"two"})]
    pts = spark.createDataFrame([p[:2] for p in points], POINT)
    got = {}
    for r in spatial.join_within(pts, polys, 1.0).collect():
        got.setdefault((r.x, r.y), set()).add(r.geoid)
    assert got == {(x, y): want | {"wide"} for x, y, want in points}


def test_a_wide_area_does_not_multiply_rows(spark):
    """One area a million cells wide: its box is on at most four cells of its own grid."""
    polys = spark.createDataFrame([("wide", square(0.0, 0.0, 1e6)), ("small", square(3.0, 3.0))], f"geoid string, ring {RING}")
    pts = spark.createDataFrame([(3.5, 3.5), (9.5, 9.5)], POINT)
    out = spatial.join_within(pts, polys, 1.0)
    assert {(r.x, r.geoid) for r in out.collect()} == {(3.5, "wide"), (3.5, "small"), (9.5, "wide")}


def test_nearest_target(spark):
    rnd = random.Random(8)
    targets = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(500)] + [(1000, 400.0, 400.0), (1001, 400.0, 402.0)]
    points = [(i, rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(300)] + [(900, 400.0, 401.0), (901, -900.0, 0.0)]
    t = spark.createDataFrame(targets, "target int, x double, y double")
    p = spark.createDataFrame(points, "id int, x double, y double")
    got = {r.id: r.target for r in regions.nearest(p, t).collect()}
    assert got == {i: min(targets, key=lambda z: ((z[1] - x) ** 2 + (z[2] - y) ** 2, z[0]))[0] for i, x, y in points}
    assert regions.nearest(p.limit(0), t).count() == 0


def test_partial_edges_away_from_the_origin(spark):
    """Edges of 10 to 1,000 m at longitude -87, latitude 42, in any direction: each meets an edge over a part of it whose ends
    are computed, and all pairs are found; edges beside the line are not."""
    rnd = random.Random(12)
    layer, want = [], set()
    for i in range(300):
        x, y, turn = -87 + rnd.uniform(-0.3, 0.3), 42 + rnd.uniform(-0.3, 0.3), rnd.uniform(0, 2 * math.pi)
        size = 1e-4 * 10 ** rnd.uniform(0, 2)
        ux, uy = math.cos(turn), math.sin(turn)
        at = lambda s, t: (x + s * ux * size - t * uy * size, y + s * uy * size + t * ux * size)  # noqa: E731, B023
        s0, s1 = sorted((rnd.uniform(0.0, 0.45), rnd.uniform(0.55, 1.4)))
        layer.append((f"{i:03}a", [at(0, 0), at(1, 0), at(0.5, 1), at(0, 0)]))
        layer.append((f"{i:03}b", [at(s0, 0), at(0.5, -1), at(s1, 0), at(s0, 0)]))
        layer.append((f"{i:03}c", [at(s0, -1.5), at(s1, -1.5), at(0.5, -2), at(s0, -1.5)]))
        want.add((f"{i:03}a", f"{i:03}b"))
    got = {(r.a, r.b) for r in regions.shared_edges(spark.createDataFrame(layer, f"geoid string, ring {RING}")).collect()}
    assert {p for p in got if p[0][:3] == p[1][:3]} == want  # triangles of different places may meet nowhere


def test_a_long_edge_beside_many_corners(spark):
    """One area with an edge as long as ten thousand others: it looks for corners in pieces."""
    layer = [("long", [(0.0, 0.0), (1000.0, 0.0), (1000.0, -1.0), (0.0, -1.0), (0.0, 0.0)])]
    layer += [(f"s{i}", square(i * 0.5, (i % 7) * 0.5, 0.5)) for i in range(2000)]
    got = {(r.a, r.b) for r in regions.shared_edges(spark.createDataFrame(layer, f"geoid string, ring {RING}")).collect()}
    assert {b for a, b in got if a == "long"} == {f"s{i}" for i in range(0, 2000, 7)}


def test_nearest_of_clustered_targets(spark, monkeypatch):
    """Nine targets of ten in a ten-thousandth of the box: a point keeps a few nodes a round, and meets a few targets."""
    rnd = random.Random(4)
    n = 20_000
    targets = [(i, rnd.uniform(0.5, 0.51), rnd.uniform(0.5, 0.51)) if i % 10 else (i, rnd.random(), rnd.random()) for i in range(n)]
    points = [(i, rnd.random(), rnd.random()) if i % 2 else (i, rnd.uniform(0.49, 0.52), rnd.uniform(0.49, 0.52)) for i in range(1000)]
    held, plain = [], regions.stage

    def counted(df, label="stage", **counts):
        out = plain(df, label, **counts)
        held.append((label, out.rows))
        return out

    monkeypatch.setattr(regions, "stage", counted)
    t = spark.createDataFrame(targets, "target int, x double, y double").repartition(8)
    got = {r.id: r.target for r in regions.nearest(spark.createDataFrame(points, "id int, x double, y double"), t).collect()}
    import numpy as np

    xy = np.array([z[1:] for z in targets])
    for i, x, y in points:
        d = ((xy - (x, y)) ** 2).sum(1)
        assert d[got[i]] <= d.min() * (1 + 1e-6)
    searched = [rows for label, rows in held if label == "search"]
    assert 3 < len(searched) < 12 and max(searched) < 16 * len(points)  # a round joins at most 16 children to each


def test_nearest_with_equal_spots_and_missing_numbers(spark):
    t = spark.createDataFrame([(5, 1.0, 1.0), (3, 1.0, 1.0), (9, None, 1.0), (2, float("nan"), 1.0)], "target int, x double, y double")
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 1.0, 1.0)], "id int, x double, y double")
    assert sorted(map(tuple, regions.nearest(p, t).collect())) == [(1, 3), (3, 3)]
    assert regions.nearest(p, t.limit(0)).count() == 0

import numpy as np
import pytest
from pyspark.sql import functions as F

from levyscope.llm import covertree
from tests.llm.test_simhash import components


def expected(rows, least=0.95):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, (i, v) in enumerate(good):
        for j, w in good[a + 1 :]:
            if len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                links.append((i, j))
    c = components([i for i, _ in rows if i is not None], links)
    n = {i: sum(i in p for p in links) for i in c}
    return {i: (n[i], c[i], c[i] == i) for i in c}


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, node int").repartition(4)
    out = covertree.near_vectors(df).collect()
    assert len(out) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}


def vectors(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((max(1, n // 8), dims))
    x = base[rng.integers(0, len(base), n)] + spread * rng.standard_normal((n, dims))
    return [(int(i), [float(np.float32(v)) for v in row]) for i, row in zip(rng.permutation(10 * n)[:n], x)]


@pytest.mark.parametrize("dims,spread", [(8, 0.2), (3, 0.02), (32, 0.15)])
def test_equals_brute_force(spark, monkeypatch, dims, spread):
    rows = vectors(300, dims, dims, spread)
    rows += [(50_000 + k, list(v)) for k, (_, v) in enumerate(rows[:20])]  # copies
    rows += [(60_000 + k, [2 * c for c in v]) for k, (_, v) in enumerate(rows[:20])]  # the same direction
    rows += [(70_000, None), (70_001, []), (70_002, [0.0] * dims), (70_003, [float("nan")] * dims), (70_004, [float("inf")] + [0.0] * (dims - 1))]
    rows += [(70_005, [None] + [1.0] * (dims - 1)), (70_006, [1.0]), (70_007, [3.0]), (None, list(rows[0][1]))]
    want = expected(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(covertree, "TILE", 40)
    monkeypatch.setattr(covertree, "LEAF", 8)
    assert run(spark, rows) == want


def test_hooks_and_empty(spark):
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in covertree.near_vectors(df).collect()) == [(1, 0, 1, True), (3, 1, 3, True), (3, 1, 3, True)]


def test_tree_covers_and_halves():
    x = np.random.default_rng(1).standard_normal((3000, 2))
    todo = [covertree.build(x, np.arange(len(x)))]
    assert todo[0].children
    while todo:
        ball = todo.pop()
        assert (np.linalg.norm(x[ball.rows] - ball.centre, axis=1) <= ball.radius + 1e-12).all()
        if ball.children:
            assert np.array_equal(np.sort(np.concatenate([c.rows for c in ball.children])), np.sort(ball.rows))
            assert (ball.children[0].centre == ball.centre).all() and ball.children[0].radius <= ball.radius / 2
        todo += ball.children


def test_every_cell_in_several_chunks(spark, monkeypatch):
    """As many cells as there may be, nearly all of several chunks."""
    monkeypatch.setattr(covertree, "TILE", 4)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12_000, 16)).astype(np.float32)
    x[6000:] = x[:6000] + np.float32(1e-4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    distinct = df.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), "embedding")
    links = covertree.link_vectors(distinct, 0.999).select(F.min("node"), F.count("*"))
    # planning alone overflowed the stack with a condition per cell
    assert "FlatMapGroupsInArrow" in links._jdf.queryExecution().executedPlan().toString()

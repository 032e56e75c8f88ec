import math

import numpy as np
import pytest

from levyscope.llm import whitening
from levyscope.llm.whitening import whitened_components

SCHEMA = "vec_id long, embedding array<float>, x int, row string, whitened int"


def expected(vectors, components=32):
    """Dense numpy over the whole-number entries, and exact deviations in Python integers."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(v, total))) for v in x]
    c = np.array([[float(n * a - s) / n for a, s in zip(v, total)] for v in x])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, deviation, c @ u / np.sqrt(e), e / np.trace(v)


def data(n=300, width=40, seed=2):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(n, width)) @ rnd.normal(size=(width, width)) * 0.1).astype(np.float32)


@pytest.mark.parametrize("cells", [1 << 18, 40 * 16])
def test_equals_dense_numpy(spark, monkeypatch, cells):
    """In one block, and in blocks of 16 rows over many tasks."""
    monkeypatch.setattr(whitening, "CELLS", cells)
    vectors = data()
    rows = [(i, [float(c) for c in v], 1, "r", 2) for i, v in enumerate(vectors)]
    bad = [(900, None, 1, "", 1), (901, [float("nan")] * 40, 1, "", 1), (902, [None] * 40, 1, "", 1), (903, [float("inf")] + [0.0] * 39, 1, "", 1)]
    bad += [(904, [1.0] * 39, 1, "", 1), (905, [], 1, "", 1), (906, [3e38] + [0.0] * 39, 1, "", 1)]
    out = whitened_components(spark.createDataFrame(rows + bad, SCHEMA).repartition(5)).toPandas()
    n, deviation, white, explained = expected(vectors)
    assert len(out) == n * 32 and set(out.n) == {n} and list(out.columns) == "vec_id component n deviation whitened explained identity_error".split()
    out = out.sort_values(["vec_id", "component"])
    got = out.whitened.to_numpy().reshape(n, 32)
    sign = np.sign((got * white).sum(0))
    assert np.abs(got - white * sign).max() < 1e-8
    assert out.deviation.to_numpy()[::32].tolist() == deviation
    assert np.abs(out.explained.to_numpy()[:32] / explained - 1).max() < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9


def test_fewer_dimensions_repeated_rows_and_nulls(spark):
    """Constant and dependent dimensions have no component; equal rows and null ids are rows of their own."""
    base = [[float(i), 2.0 * i, 5.0, float(i * i % 7)] for i in range(20)]
    rows = [(None if i == 3 else i % 10, v, 1, "r", 2) for i, v in enumerate(base + base[:4])]
    out = whitened_components(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(out) == 24 * 2 and set(out.component) == {1, 2} and out.vec_id.isna().sum() == 2
    assert out.identity_error.max() < 1e-9


def test_tables_without_anything_to_fit(spark):
    for rows in ([], [(1, None, 1, "", 1)], [(1, [1.0, 2.0], 1, "", 1)], [(1, [1.0], 1, "", 1), (2, [1.0], 1, "", 1)]):
        assert whitened_components(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_plan_has_no_python(spark):
    rows = [(i, [float(c) for c in v], 1, "r", 2) for i, v in enumerate(data(20, 3))]
    plan = whitened_components(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

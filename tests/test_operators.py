"""Operators on small hand-made frames, in the in-task and in the distributed form."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from levyscope import scale
from levyscope.operators import outliers, rank, ratios, shape, shares
from levyscope.operators.smooth import loess_by
from levyscope.scale import attach_groups, join_null_safe, row_hash, stage


@pytest.fixture(params=["small", "distributed"])
def form(request):
    """Row count handed to the operators: measured and small, or a run in which every size check fails."""
    if request.param == "distributed":
        request.getfixturevalue("distributed")
    return 1000


def test_latest_sale_per_key(spark):
    rows = [("p", 2018, 1, 10), ("p", 2018, 3, 11), ("p", 2018, 3, 12), ("p", 2019, None, 13), ("q", 2018, None, 14), ("q", 2018, 1, 15)]
    df = spark.createDataFrame(rows, "pin string, year int, sold int, sale_key int")
    out = rank.latest_per_key(df, ["pin", "year"], "sold", "sale_key").orderBy("pin", "year").collect()
    assert [(r.pin, r.year, r.sale_key) for r in out] == [("p", 2018, 12), ("q", 2018, 15)]


def test_group_limit_runs_ahead_of_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as v", "id as t")
    plan = rank.latest_per_key(df, ["k"], "v", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one on each side of the exchange


def test_top_category_ties_zero_and_missing(spark):
    rows = [("a", "x", 5.0, 10.0), ("a", "y", 5.0, 10.0), ("b", "x", 0.0, 0.0), ("c", "x", 0.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, race string, est double, total double")
    df = df.withColumn("share", F.when(F.col("total") == 0, float("nan")).otherwise(F.try_divide("est", "total")))
    out = rank.top_category(df, "g", "share", "race", also=F.col("est") > 0).collect()
    assert [(r.g, r.race) for r in out] == [("a", "x")]  # b has no share, c's largest is empty


def test_ntile_larger_tiles_first_and_missing_left_out(spark, form):
    rows = [("g", float(v), i) for i, v in enumerate([10, 20, 20, 30, 40, 50])] + [("g", None, 6), ("g", float("nan"), 7)]
    df = spark.createDataFrame(rows, "g string, v double, t int")
    out = {r.t: r.tile for r in rank.ntile(df, "tile", 4, ["g"], "v", "t", form).collect()}
    assert [out[i] for i in range(6)] == [1, 1, 2, 2, 3, 4]
    assert out[6] is None and out[7] is None


def test_ntile_with_one_hot_group_and_few_rows(spark, distributed):
    rnd = random.Random(1)
    rows = [("hot", float(rnd.randint(0, 50)), i) for i in range(900)] + [("cold", 1.0, 900 + i) for i in range(3)] + [(None, 2.0, 999)]
    df = spark.createDataFrame(rows, "g string, v double, t int").repartition(6)
    got = {r.t: r.tile for r in rank.ntile(df, "tile", 100, ["g"], "v", "t").collect()}
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[2]))
    assert [got[r[2]] for r in hot] == [i // 9 + 1 for i in range(900)]
    assert [got[900 + i] for i in range(3)] == [1, 2, 3] and got[999] == 1


def test_a_hot_group_spans_many_tasks(spark, distributed, monkeypatch):
    written = []

    def keep(df, label="stage", **counts):
        written.append(stage(df, label, **counts))
        return written[-1]

    monkeypatch.setattr(rank, "stage", keep)
    df = spark.range(4000).selectExpr("if(id % 10 = 0, 'cold', 'hot') AS g", "id % 7 AS v", "id AS t")
    out = rank.ranked(df, ["g"], ["v", "t"])
    parts = written[0].df.where("g = 'hot'").groupBy(F.shiftright("_mid", 33).alias("part")).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 3600 / 2
    assert {r.g: r.last for r in out.groupBy("g").agg(F.max("_rank").alias("last")).collect()} == {"hot": 3599, "cold": 399}
    assert out.where("g = 'hot'").select("_rank").distinct().count() == 3600


def quantile7(xs, p):
    xs = sorted(xs)
    pos = (len(xs) - 1) * p
    lo = int(pos)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (xs[hi] - xs[lo]) * (pos - lo)


def test_quantiles_are_exact(spark, form):
    rnd = random.Random(2)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(501)], "b": [3.0] * 400, "c": [7.5], None: [1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = {"p1": 0.01, "q1": 0.25, "med": 0.5, "p99": 0.99}
    out = {r.g: r for r in outliers.group_quantiles(df, "x", ["g"], probs, form).collect()}
    assert set(out) == set(groups)
    for g, xs in groups.items():
        for name, p in probs.items():
            assert out[g][name] == pytest.approx(quantile7(xs, p), abs=1e-12)


def test_fence_flag_is_strict(spark, form):
    rows = [("one", 1.0), *[("many", float(v)) for v in (1, 2, 3, 4, 100)], ("many", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = outliers.ratio_flags(df, "x", ["g"], form)
    got = {(r.g, r.x): (r.outlier_flag_iaao, r.av_ratio_1_to_99) for r in out.collect()}
    assert got[("one", 1.0)] == (0, 1)  # a lone value lies on its own fences
    assert got[("many", 100.0)] == (0, 0) and got[("many", 3.0)] == (1, 1) and got[("many", None)] == (0, 1)


def test_zscore_uses_sample_sd(spark, form):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 5.0)], "g string, x double")
    got = {(r.g, r.x): r.zscore for r in outliers.zscore_by_group(df, "x", ["g"], rows=form).collect()}
    assert got[("a", 6.0)] == pytest.approx(3 / statistics.stdev([1, 2, 6])) and got[("b", 5.0)] is None


def test_missing_keys_meet(spark):
    left = spark.createDataFrame([("City", 1), (None, 2), ("North", 3)], "t string, n int")
    right = spark.createDataFrame([("City", "x"), (None, "y"), (None, "z")], "t string, r string")
    out = join_null_safe(left, right, ["t"]).collect()
    assert sorted((r.n, r.r or "") for r in out) == [(1, "x"), (2, "y"), (2, "z"), (3, "")]


def test_attach_groups_same_result_in_each_form(spark, form):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 5, i) for i in range(200)], "g int, i int")
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    out = attach_groups(df, stats, ["g"], form).collect()
    assert len(out) == 200 and {r.c for r in out} == {40}


def test_stage_counts_what_it_writes(spark):
    staged = stage(spark.range(1234).withColumn("x", F.lit(1.5)))
    assert staged.rows == 1234 and staged.df.count() == 1234 and staged.small is (scale.SMALL_ROWS >= 1234)


def test_cod_prd_prb_of_level_ratios(spark, form):
    rows = [(2020, 0.1, 1000.0 * (i + 1), 100.0 * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "year int, r double, price double, av double")
    assert ratios.cod(df, "r", ["year"], form).first().cod == pytest.approx(0, abs=1e-12)
    assert ratios.prd(df, "r", "price", ["year"], form).first().prd == pytest.approx(1)
    terms = ratios.prb_terms(df, "r", "av", "price", ["year"], form)
    fit = ratios.ols_interval(terms, "prb_pct_diff", "prb_ln_value", ["year"]).first()
    assert fit.est == pytest.approx(0, abs=1e-9) and fit.upper - fit.lower == pytest.approx(0, abs=1e-6)


def test_cod_by_hand(spark, form):
    df = spark.createDataFrame([(1, x) for x in (0.8, 1.0, 1.3)], "year int, r double")
    got = ratios.cod(df, "r", ["year"], form).first()
    assert got.cod == pytest.approx((0.2 + 0 + 0.3) / 3 / 1.0) and got.n == 3


def test_intervals_pooled_and_not(spark):
    rnd = random.Random(3)
    rows = []
    for g, noise in (("quiet", 0.1), ("loud", 2.0)):
        rows += [(g, float(x), 1 + 2 * x + rnd.gauss(0, noise)) for x in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    own = {r.g: r for r in ratios.ols_interval(df, "y", "x", ["g"], pool=False).collect()}
    both = {r.g: r for r in ratios.ols_interval(df, "y", "x", ["g"], pool=True).collect()}
    width = lambda r: r.upper - r.lower
    assert width(own["quiet"]) < width(both["quiet"]) and width(own["loud"]) > width(both["loud"])
    for g in own:
        xs = [r[1] for r in rows if r[0] == g]
        ys = [r[2] for r in rows if r[0] == g]
        slope, intercept = statistics.linear_regression(xs, ys)
        assert own[g].est == pytest.approx(slope) and own[g].intercept == pytest.approx(intercept)
        mx = statistics.fmean(xs)
        sxx = sum((x - mx) ** 2 for x in xs)
        rss = sum((y - intercept - slope * x) ** 2 for x, y in zip(xs, ys))
        half = 2.66329 * (rss / 58 / sxx) ** 0.5  # t table, 58 degrees of freedom, .995
        assert own[g].upper == pytest.approx(slope + half, abs=1e-4 * half)
    assert width(both["quiet"]) == pytest.approx(width(both["loud"]))


def test_prd_does_not_change_with_the_price_level(spark):
    rnd = random.Random(4)
    rows = [(y, rnd.random() + 0.1, rnd.random() * 1e5, 1.1 * (y - 2015)) for y in (2016, 2017) for _ in range(50)]
    df = spark.createDataFrame(rows, "year int, r double, price double, f double").withColumn("adj", F.col("price") * F.col("f"))
    a = {r.year: r.prd for r in ratios.prd(df, "r", "price", ["year"], 100).collect()}
    b = {r.year: r.prd for r in ratios.prd(df, "r", "adj", ["year"], 100).collect()}
    assert a == pytest.approx(b)


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(2020, 1.0, 5.0), (2020, 3.0, 5.0), (2021, 2.0, 1.0)], "year int, a double, b double")
    out = shares.share_of_total(df, ["a", "b"], ["year"]).groupBy("year").agg(F.sum("a_share"), F.sum("b_share")).collect()
    assert all(tuple(r)[1:] == pytest.approx((1.0, 1.0)) for r in out)


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, "x", 1.0)], "a int, b string, c double")
    assert {r["column"]: r.n_null for r in shares.null_profile(df).collect()} == {"a": 0, "b": 1, "c": 1}


def test_stacked_bands(spark):
    df = spark.createDataFrame([(2020, "a", 0.1), (2020, "b", 0.3)], "year int, r string, y double")
    out = {r.r: (r.lower, r.upper) for r in shares.stack(df, "year", "y", "r", []).collect()}
    assert out["b"] == pytest.approx((0.0, 0.3)) and out["a"] == pytest.approx((0.3, 0.4))


def test_names_and_levels(spark):
    df = spark.createDataFrame([("Top",), ("Other",)], "q string")
    assert shape.clean_names(df.toDF("a  b.c/d")).columns == ["a_b_c_d"]
    out = {(r.q, r.q_ord) for r in shape.ordered_category(df, "q", ["Low", "Top"]).collect()}
    assert out == {("Top", 2), (None, None)}


def test_pivot_keeps_a_missing_id(spark):
    df = spark.createDataFrame([("1", "x", 2.0), ("1", "y", 3.0), (None, "x", 4.0)], "g string, n string, v double")
    out = {r.g: (r.v_x, r.v_y) for r in shape.pivot_wide(df, ["g"], "n", ["x", "y"], ["v"]).collect()}
    assert out == {"1": (2.0, 3.0), None: (4.0, None)}


def loess_point(points, x0, span):
    """Brute force: sort the distances, fit a weighted parabola through numpy."""
    import numpy as np

    x, y, w = (np.array(c, dtype=float) for c in zip(*points))
    k = min(int(len(x) * span + 1e-5), len(x))
    h = np.sort(np.abs(x - x0))[k - 1] * max(span, 1.0)
    t = w * np.clip(1 - (np.abs(x - x0) / h) ** 3, 0, None) ** 3
    u = (x - x0) / h
    a = np.stack([np.ones_like(u), u, u * u], axis=1) * np.sqrt(t)[:, None]
    return np.linalg.lstsq(a, y * np.sqrt(t), rcond=None)[0][0]


@pytest.mark.parametrize("span", [0.75, 1.0])
def test_loess_against_brute_force(spark, form, span):
    rnd = random.Random(5)
    groups = {g: [(rnd.random() * 100, rnd.random(), rnd.randint(1, 9)) for _ in range(n)] for g, n in (("a", 40), ("b", 25))}
    rows = [(g, *p) for g, ps in groups.items() for p in ps]
    df = spark.createDataFrame(rows, "g string, x double, y double, w int")
    out = loess_by(df, "x", "y", "w", ["g"], span=span, n_grid=20).collect()
    assert len(out) == 40
    for r in out:
        assert r.y == pytest.approx(loess_point(groups[r.g], r.x, span), abs=1e-8)


def test_latest_per_key_leaves_out_nan(spark):
    rows = [("a", float("nan"), 1), ("a", 2.0, 2), ("a", None, 3), ("b", float("nan"), 4)]
    df = spark.createDataFrame(rows, "k string, v double, t int")
    assert [tuple(r) for r in rank.latest_per_key(df, ["k"], "v", "t").collect()] == [("a", 2.0, 2)]


def test_pivot_of_an_unlisted_category_is_an_error(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "?", 3.0)], "id int, name string, v double")
    assert shape.pivot_wide(df, ["id"], "name", ["x", "?"], ["v"]).collect()[0]["v_x"] == 2.0
    with pytest.raises(Exception, match="none of the listed"):
        shape.pivot_wide(df, ["id"], "name", ["x"], ["v"]).collect()


def test_salts_and_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, float(i % 7)) for i in range(500)]
    a = spark.createDataFrame(rows, "id int, v double").repartition(5)
    b = spark.createDataFrame(rows[::-1], "id int, v double").repartition(3)
    hashes = [dict(map(tuple, d.select("id", row_hash(d)).collect())) for d in (a, b)]
    assert hashes[0] == hashes[1] and len(set(hashes[0].values())) == 500


def test_order_statistics_of_awkward_values(spark, distributed):
    """Outliers, ties, infinite values, tiny and huge spans, one row, missing group keys; few rounds, and no sort of the values."""
    import numpy as np

    inf = float("inf")
    rnd = random.Random(11)
    groups = {
        "skewed": [rnd.lognormvariate(0, 4) for _ in range(3000)] + [1e300, -1e300],
        "ties": [float(rnd.randint(1, 3)) for _ in range(500)],
        "one": [4.5],
        "odd": [inf, -inf, 0.0, -0.0, 1.0, inf],
        "tiny": [1.0 + i * 2.0**-52 for i in range(200)] + [5e-324, 0.0],
        "wide": [-1.7e308, 1.7e308, 3.0, 4.0],
        None: [float(i) for i in range(10)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))], "g string, v double")
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}
    rounds, plain = [], rank.stage

    def counted(frame, label="stage", **counts):
        rounds.append((label, frame._jdf.queryExecution().optimizedPlan().toString()))
        return plain(frame, label, **counts)

    rank.stage = counted
    try:
        got = {r.g: r for r in outliers.group_quantiles(df, "v", ["g"], probs).collect()}
    finally:
        rank.stage = plain
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, p in probs.items():
            at = (len(vs) - 1) * p
            lo, hi, share = vs[int(np.floor(at))], vs[int(np.ceil(at))], at - np.floor(at)
            want = lo if lo == hi else (1 - share) * lo + share * hi
            assert got[g][name] == want or (np.isnan(want) and np.isnan(got[g][name])), (g, name)
    assert sum(label == "brackets" for label, _ in rounds) < 16
    assert not any("RepartitionByExpression" in text or "Sort [" in text for _, text in rounds)


def test_tiles_that_start_in_the_midst_of_equal_values(spark, distributed):
    """Few distinct values: most tiles start among equals, which the tie orders; groups smaller than the tiles; missing values."""
    rnd = random.Random(3)
    rows = [("a", float(rnd.randint(1, 4)), i) for i in range(1003)] + [("b", 1.0, 5000 + i) for i in range(7)]
    rows += [(None, rnd.random(), 6000 + i) for i in range(57)] + [("a", None, 7000), ("a", float("nan"), 7001), ("c", float("inf"), 7002)]
    df = spark.createDataFrame(rows, "g string, v double, t int")
    for k in (1, 4, 100):
        got = {r.t: r.tile for r in rank.ntile(df, "tile", k, ["g"], "v", "t").collect()}
        assert len(got) == len(rows) and got[7000] is None and got[7001] is None and got[7002] == 1
        for g in ("a", "b", None):
            mine = sorted((v, t) for h, v, t in rows if h == g and v is not None and v == v)
            q, r = divmod(len(mine), k)
            want = [tile for tile in range(1, k + 1) for _ in range(q + (tile <= r))]
            assert [got[t] for _, t in mine] == want, (k, g)

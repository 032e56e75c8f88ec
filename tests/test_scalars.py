"""Missing values, division, dates, codes and labels: the expected values are the study's, written out."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from levyscope.functions import scalars as fn
from levyscope.functions import sums
from levyscope.operators import shares


def values(spark, schema, rows, *exprs):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r) for r in df.orderBy("i").select(*exprs).collect()]


def test_division_keeps_infinity_and_missing_apart(spark):
    rows = [(5.0, 2.0), (5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (None, 5.0), (5.0, None), (float("nan"), 0.0)]
    out = [r[0] for r in values(spark, "a double, b double", rows, fn.ieee_div(F.col("a"), F.col("b")))]
    assert out[:3] == [2.5, math.inf, -math.inf]
    assert math.isnan(out[3]) and out[4] is None and out[5] is None and math.isnan(out[6])


def test_comparisons_are_false_for_missing_and_nan(spark):
    rows = [(2.0, 1.0), (1.0, 2.0), (float("nan"), 1.0), (None, 1.0), (1.0, None)]
    out = values(spark, "a double, b double", rows, fn.above(F.col("a"), F.col("b")), fn.below(F.col("a"), F.col("b")))
    assert out == [(True, False), (False, True), (False, False), (False, False), (False, False)]


def test_strict_aggregates_turn_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "k string, x double")
    x = F.col("x")
    out = df.groupBy("k").agg(fn.strict_sum(x), fn.strict_mean(x), fn.strict_sd(x)).orderBy("k").collect()
    assert tuple(out[0]) == ("a", 4.0, 2.0, pytest.approx(math.sqrt(2)))
    assert tuple(out[1]) == ("b", None, None, None)


def test_padding_never_cuts(spark):
    rows = [("123456789012",), ("12345678901234",), ("1234567890123456",), (None,)]
    out = [r[0] for r in values(spark, "p string", rows, fn.pad_left(F.col("p"), 14))]
    assert out == ["00123456789012", "12345678901234", "1234567890123456", None]


def test_dates_short_full_and_bad(spark):
    rows = [("Mar 05 2018",), ("March 5 2018",), ("May 31 2019",), ("September 09 2020",), ("Feb 30 2018",), ("soon",), (None,)]
    out = [r[0] for r in values(spark, "d string", rows, fn.month_date(F.col("d")).cast("date"))]
    assert out == [
        dt.date(2018, 3, 5), dt.date(2018, 3, 5), dt.date(2019, 5, 31), dt.date(2020, 9, 9), None, None, None,
    ]


def test_class_codes(spark):
    rows = [(202.0,), (20200.0,), (203.99,), (None,)]
    assert [r[0] for r in values(spark, "c double", rows, fn.class_code(F.col("c")))] == ["202", "202", "203.99", None]


def test_paste_writes_missing_as_text(spark):
    rows = [("Kaegi", 2019), (None, 1990)]
    assert [r[0] for r in values(spark, "t string, y int", rows, fn.paste(F.col("t"), F.col("y")))] == ["Kaegi 2019", "NA 1990"]


def test_safe_log10(spark):
    rows = [(1000.0,), (0.0,), (-5.0,), (5.0,), (float("nan"),), (float("inf"),), (None,)]
    assert [r[0] for r in values(spark, "x double", rows, fn.safe_log10(F.col("x")))] == [3.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_labels_round_halves_to_even(spark):
    rows = [(0.125,), (0.025,), (0.135,)]
    assert [r[0] for r in values(spark, "v double", rows, fn.percent_label(F.col("v")))][:2] == ["12%", "2%"]
    rows = [(2.34e9,), (2.0e10,), (9.96e9,), (0.0,)]
    assert [r[0] for r in values(spark, "v double", rows, fn.billions_label(F.col("v")))] == ["$2.3B", "$20B", "$10B", "$0B"]


def test_squish_and_membership(spark):
    rows = [(-1.0,), (0.1,), (7.0,), (None,)]
    assert [r[0] for r in values(spark, "v double", rows, fn.squish(F.col("v"), 0.0, 0.2))] == [0.0, 0.1, 0.2, None]
    rows = [("a",), ("z",), (None,)]
    assert [r[0] for r in values(spark, "v string", rows, fn.in_set(F.col("v"), ["a"]))] == [True, False, False]


# quantiles at .95, .975 and .995 from printed tables of ten digits
T_TABLE = {
    1: (6.313751515, 12.70620474, 63.65674116),
    2: (2.919985580, 4.302652730, 9.924843201),
    3: (2.353363435, 3.182446305, 5.840909310),
    4: (2.131846786, 2.776445105, 4.604094871),
    5: (2.015048373, 2.570581836, 4.032142984),
    10: (1.812461123, 2.228138852, 3.169272673),
    30: (1.697260887, 2.042272456, 2.749995654),
    100: (1.660234326, 1.983971519, 2.625890521),
    1_000_000: (1.644855150, 1.959966359, 2.575834),
}


def test_t_quantile_against_tables(spark):
    df = spark.createDataFrame([(n,) for n in T_TABLE], "n long")
    cols = [fn.t_quantile(p, F.col("n")) for p in (0.95, 0.975, 0.995)]
    for n, *got in df.select("n", *cols).collect():
        assert got == pytest.approx(T_TABLE[n], abs=1e-6), n


def test_t_quantile_is_the_inverse_of_the_tail(spark):
    """For all whole degrees of freedom to 30, around the change of method, broken ones, and both sides of one half."""
    frees = [*map(float, range(1, 31)), 0.3, 1.5, 2.5, 17.25, 99.0, 199.0, 199.5, 200.0, 250.0]
    df = spark.createDataFrame([(n,) for n in frees], "n double")
    levels = (0.55, 0.75, 0.9, 0.95, 0.975, 0.995, 0.9995)
    found = df.select("n", *[fn.t_quantile(p, F.col("n")).alias(f"t{k}") for k, p in enumerate(levels)]).collect()
    found = spark.createDataFrame(found)
    for n, *got in found.select("n", *[fn.t_tail(F.col(f"t{k}"), F.col("n")) for k in range(len(levels))]).collect():
        assert got == pytest.approx([1 - p for p in levels], rel=1e-8), n
    low, mid = df.select(fn.t_quantile(0.025, F.col("n")) + fn.t_quantile(0.975, F.col("n")), fn.t_quantile(0.5, F.col("n"))).first()
    assert low == 0 and mid == 0
    odd = spark.createDataFrame([(0.0,), (-1.0,), (None,)], "n double")
    assert [r[0] for r in odd.select(fn.t_quantile(0.975, F.col("n"))).collect()] == [None] * 3


def test_the_list_for_the_oracle_agrees(spark):
    from levyscope.registry.pipelines import t995

    want = t995()
    df = spark.range(1, len(want) + 1).select("id", fn.t_quantile(0.995, F.col("id")).alias("t"))
    assert [r.t for r in df.orderBy("id").collect()] == pytest.approx(want, rel=1e-9)


def one(spark, column, *values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_labels_and_clamps_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    assert one(spark, fn.percent_label, 0.126, nan, inf, -inf, None, 1e20) == ["13%", "NaN%", "Inf%", "-Inf%", None, "1.0E22%"]
    out = one(spark, lambda v: fn.squish(v, 0.0, 0.2), 0.1, 9.0, -9.0, inf, -inf, None)
    assert out == [0.1, 0.2, 0.0, inf, -inf, None]
    assert math.isnan(one(spark, lambda v: fn.squish(v, 0.0, 0.2), nan)[0])
    assert one(spark, fn.billions_label, 400.0, 4.26e9, 0.0, None) == ["$4.0E-7B", "$4.3B", "$0B", None]


def test_means_with_missing_and_nan(spark):
    rows = [("a", 0.5, 10.0), ("a", None, 1000.0), ("b", float("nan"), 1.0), ("b", 5.0, 1.0), ("c", 2.0, 3.0), ("c", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    got = df.groupBy("g").agg(fn.weighted_mean(F.col("x"), F.col("w")).alias("wm"), fn.mean_of_numbers(F.col("x")).alias("m"))
    got = {r.g: (r.wm, r.m) for r in got.collect()}
    assert got["a"] == (None, 0.5) and got["b"][1] == 5.0 and got["c"] == (2.5, 3.0)


def test_exact_sums_do_not_depend_on_order(spark):
    import random
    from fractions import Fraction

    pick = random.Random(5)
    x = [pick.choice([1, -1]) * pick.random() * 10.0 ** pick.randint(-9, 17) for _ in range(4000)]
    x += [round(pick.random() * 1e6, 2) for _ in range(4000)] + [-5.0, 0.0, -0.0, 2.0**59]
    want = float(sum(map(Fraction, x)) - Fraction(2.0**59)), float(sum(map(Fraction, x)))
    got = set()
    for k, parts in enumerate((1, 3, 16)):
        pick.shuffle(x)
        df = spark.createDataFrame([(v,) for v in x], "x double").repartition(parts)
        few = df.where(F.col("x") < 2.0**58)
        out = few.agg(sums.exact_sum(F.col("x")), fn.strict_mean(F.col("x")), fn.weighted_mean(F.col("x"), 1 / (1 + F.abs("x")))).first()
        got.add((*out, df.agg(sums.exact_sum(F.col("x"))).first()[0]))
    assert len(got) == 1
    (total, mean, _, large), = got
    assert total == pytest.approx(want[0], rel=1e-15) and mean == total / (len(x) - 1)
    assert large == pytest.approx(want[1], rel=1e-15)


def test_exact_sums_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    cases = {
        "a": [inf, 1.0], "b": [inf, -inf], "c": [nan, 1.0], "d": [None, None], "e": [1e300, 1.0], "f": [1e-300, 2e-300],
        "g": [None, -0.1], "h": [1e17, -1e17, 2.0**-20], "i": [-(2.0**-60), 2.0**-59], "j": [5e-324],
    }
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, x double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(sums.exact_sum(F.col("x")).alias("s"), sums.exact_mean(F.col("x")).alias("m")).collect()}
    assert got["a"] == (inf, inf) and math.isnan(got["b"][0]) and math.isnan(got["c"][0]) and got["d"] == (None, None)
    assert got["e"][0] == 1e300 and got["f"][0] == 3e-300 and got["g"] == (-0.1, -0.1)
    assert got["h"][0] == 2.0**-20 and got["i"][0] == 2.0**-60 and got["j"][0] == 5e-324
    whole = spark.createDataFrame([(1, 2.5), (2, 3.5)], "n long, x double")
    assert whole.agg(sums.sum_of(whole, "n"), sums.sum_of(whole, "x")).first() == (3, 6.0)


def test_group_sums_are_the_same_over_partitionings(spark):
    rows = [(k % 3, math.sin(k) * 10 ** (k % 12), k) for k in range(3000)]
    got = set()
    for parts in (1, 4, 13):
        df = spark.createDataFrame(rows, "g int, x double, n int").repartition(parts)
        got.add((
            tuple(sorted(map(tuple, shares.sum_by(df, ["g"], ["x", "n"]).collect()))),
            tuple(sorted(r.x_share for r in shares.share_of_total(df, ["x"], ["g"]).collect())),
            tuple(sorted(r.x_share for r in shares.share_of_total(df, ["x"], ["g"], summary=True).collect())),
        ))
    (sums_of, joined, windowed), = got
    assert isinstance(sums_of[0][2], int) and joined == windowed

"""Row numbers, tiles and first-per-group selection that hold when one group has a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.functions.scalars import is_number, nan_as_missing
from levyscope.scale import attach_groups, is_small, join_null_safe, stage


def latest_per_key(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, the greatest ``tie`` among equals; rows without an order value
    are out.

    Catalyst turns the filter on the row number into a group limit ahead of the shuffle: every map task sends at most
    one row per key, so a key with very many rows costs no more than any other.
    """
    place = F.col(order)
    if df.schema[order].dataType.typeName() in ("double", "float"):
        place = nan_as_missing(place)  # NaN would rank above every number
    w = Window.partitionBy(*keys).orderBy(place.desc(), F.col(tie).desc())
    ranked = df.withColumn("__rn", F.row_number().over(w))  # missing order values come last
    return ranked.where((F.col("__rn") == 1) & place.isNotNull()).drop("__rn")


def dedup_first(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """One row per key, the smallest by ``ties``."""
    w = Window.partitionBy(*keys).orderBy(*ties)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_category(df: DataFrame, key: str, share: str, tie: str, also: Column | None = None) -> DataFrame:
    """Category with the largest share per key. ``also`` is applied after ranking, so it can empty a key."""
    w = Window.partitionBy(key).orderBy(F.col(share).desc(), F.col(tie))
    ranked = df.where(is_number(F.col(share))).withColumn("__rn", F.row_number().over(w))
    keep = F.col("__rn") == 1
    return ranked.where(keep if also is None else keep & also).drop("__rn")


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``_rank`` (0-based place within ``by`` under ``order``) and ``_n`` (rows of the group), at any group size.

    The rows are range-partitioned on group *and* order, so a hot group spans many tasks, then sorted and written with
    a row id that holds the partition and the place in it. The start of each (group, partition) span plus the number of
    rows in the group's earlier partitions gives the place; there are at most partitions + groups spans.
    """
    keys = [*by, *order]
    placed = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()),
        "ranked",
    ).df.withColumn("_part", F.shiftright("_mid", 33))
    spans = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_len"), F.min("_mid").alias("_first"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns(
        {"_before": F.coalesce(F.sum("_len").over(earlier), F.lit(0)), "_n": F.sum("_len").over(group)}
    )
    spans = stage(spans.drop("_len"), "spans")
    out = join_null_safe(placed, spans.df, [*by, "_part"], "inner", small=spans.small)
    return out.withColumn("_rank", F.col("_before") + F.col("_mid") - F.col("_first")).drop(
        "_mid", "_part", "_first", "_before"
    )


#: Bins that a bracket is divided into in one round.
BINS = 1024
MOST = 1.7976931348623157e308


def order_statistics(valid: DataFrame, value: str, by: list[str], places: list[Column]) -> DataFrame:
    """The values of ``valid`` at 0-based ``places`` (expressions of ``_n``, the size of the group) within their group, as columns
    ``__o0``, ``__o1``, ... beside ``_n``, by ``select_places``."""
    found = select_places(valid, value, by, places)
    return found.groupBy(*by).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_i") == i, F.col("_value"))).alias(f"__o{i}") for i in range(len(places))]
    )


def select_places(valid: DataFrame, value: str, by: list[str], places: list[Column]) -> DataFrame:
    """(by, _n, _i, _value, _after) for the i-th of ``places``: the value that stands there within its group, and how many equal
    values stand before it. A place beyond the group has no row. Values must be numbers; infinite ones are taken as the greatest
    and least doubles.

    Selection by refinement: every wanted place has a bracket of values that holds it, at first the whole group. A round counts
    the values of every bracket in ``BINS`` bins (with the least and greatest value of each, by partial aggregates), and the bin
    that holds the place is the next bracket, until it holds one value only. Nothing is sorted, and no value but the ends of
    bins leaves a map task, so it does not matter how the values are spread or how large a group is. A bin is a
    function of the value that never falls, so rounding cannot misplace a value. Three or four rounds settle a billion values.
    """
    x = F.least(F.greatest(F.col(value).cast("double"), F.lit(-MOST)), F.lit(MOST))
    base = stage(valid.select(*by, x.alias("_x")), "values").df  # read in every round
    whole = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    slots = F.array(*[F.struct(F.lit(i).alias("_i"), p.cast("long").alias("_k")) for i, p in enumerate(places)])
    key = [*by, "_n", "_i", "_k", "_lo", "_hi"]
    whole = whole.select(*by, "_n", "_lo", "_hi", F.inline(slots)).where("_k < _n").select(key)
    want = stage(whole, "brackets", open=F.col("_lo") < F.col("_hi"))
    while want.counts["open"]:
        left = want.df.where("_lo < _hi")
        # of one group brackets are equal or apart, so a value is in one of them at most
        brackets = left.groupBy(*by).agg(F.collect_set(F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))).alias("_b"))
        held = attach_groups(base, brackets, by, width=16 * len(places) + 100)
        hit = F.get(F.filter("_b", lambda b: (F.col("_x") >= b["lo"]) & (F.col("_x") <= b["hi"])), F.lit(0))
        held = held.select(*by, "_x", hit.alias("_hit")).where("_hit IS NOT NULL").select(*by, "_x", "_hit.lo", "_hit.hi")
        span = F.col("hi") - F.col("lo")
        far = span > MOST  # the difference of two doubles may pass all of them
        share = F.when(far, (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise((F.col("_x") - F.col("lo")) / span)
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        bins = held.groupBy(*by, F.col("lo").alias("_lo"), bin_.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most")
        )
        upto = F.sum("_c").over(Window.partitionBy(*by, "_lo").orderBy("_bin"))  # at most BINS rows in a partition
        bins = bins.withColumn("_upto", upto)
        met = join_null_safe(left.drop("_hi"), bins, [*by, "_lo"], "inner")
        met = met.where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
        nearer = met.select(
            *by, "_n", "_i", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi")
        )
        want = stage(want.df.where("_lo >= _hi").unionByName(nearer), "brackets", open=F.col("_lo") < F.col("_hi"))
    v = F.col("_lo")
    v = F.when(v == MOST, F.lit(float("inf"))).when(v == -MOST, F.lit(float("-inf"))).otherwise(v)
    return want.df.select(*by, "_n", "_i", v.alias("_value"), F.col("_k").alias("_after"))


def tile_start(n: Column, k: int, tile: int) -> Column:
    """0-based place of the first row of a 1-based tile when n rows are cut in k tiles, the larger tiles first."""
    return F.floor(n / k) * (tile - 1) + F.least(F.lit(tile - 1), n % k)


def ntile(
    df: DataFrame, name: str, k: int, by: list[str], order: str, tie: str, rows: int | None = None
) -> DataFrame:
    """Tile number within ``by``; a missing order value gets a missing tile and is not counted.

    With a small measured row count ``rows`` of ``df`` the window function does it. Otherwise the first value of every tile is
    found by ``select_places``, and a row's tile is the number of tiles that start at or below it: ``df`` is not sorted nor written,
    so several tilings of one written table share that one write. Only rows that equal the first value of a tile which starts
    in the midst of equal values are ranked by ``tie``. ``df`` is read several times.
    """
    ok = is_number(F.col(order))
    if is_small(rows):
        keyed = df.withColumn("__ok", ok)
        w = Window.partitionBy(*by, "__ok").orderBy(order, tie)
        return keyed.withColumn(name, F.when(F.col("__ok"), F.ntile(k).over(w))).drop("__ok")
    if k == 1:
        return df.withColumn(name, F.when(ok, F.lit(1)))
    starts = select_places(df.where(ok).select(*by, order), order, by, [tile_start(F.col("_n"), k, t) for t in range(2, k + 1)])
    # a tile beyond the rows of a small group has no place; an empty one would start where the next does
    starts = starts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_value").alias("v"), F.col("_after").alias("c")))).alias("__starts")
    )
    held = attach_groups(df, starts, by, width=20 * k + 100)
    x = F.col(order).cast("double")
    none = F.array().cast("array<struct<v: double, c: bigint>>")
    held = held.withColumn("__starts", F.coalesce("__starts", none))

    def passed(rank_: Column) -> Column:
        before = F.filter("__starts", lambda s: (s["v"] < x) | ((s["v"] == x) & (s["c"] <= rank_)))
        return F.when(ok, F.size(before) + 1).cast("int")

    split = F.coalesce(ok & F.exists("__starts", lambda s: (s["v"] == x) & (s["c"] > 0)), F.lit(False))
    whole = held.where(~split).withColumn(name, passed(F.lit(0).cast("long")))
    equal = ranked(held.where(split), [*by, order], [tie]).withColumn(name, passed(F.col("_rank")))
    return whole.select(*df.columns, name).unionByName(equal.select(*df.columns, name))

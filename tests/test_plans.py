"""What the plans look like, the feeds, and the readers."""

import pytest
from pyspark.sql import functions as F

from levyscope.plans import areas, charts, study
from levyscope.plans.inputs import Inputs, load_inputs
from levyscope.plans.study import Study
from levyscope.registry import fixtures
from levyscope.registry.fixtures import BASE_YEAR, CELL
from levyscope.scale import stage_path
from levyscope.sources import readers
from levyscope.sources.literals import cpi_index, reassessment_calendar


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extract_pushes_columns_and_predicate(spark, sf_dir):
    df = readers.read_extract(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderkey >= 100")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_selection_per_key_is_limited_ahead_of_the_shuffle(spark, sf_dir):
    inputs = fixtures.inputs(spark, sf_dir)
    for df in (study.latest_sales(inputs), areas.race_plurality(inputs)):
        below = plan(df).split("WindowGroupLimit", 2)[2].splitlines()[0]
        assert below.endswith("Partial")


def test_big_join_is_two_plain_exchanges(spark, sf_dir, distributed):
    """The shape adaptive execution needs to split a hot key: sort over exchange on both sides."""
    df = study.sales_ratio_base(fixtures.inputs(spark, sf_dir)).select("pin", "year", "sale_price", "av_mailed")
    lines = [x.strip(" :+-*()0123456789") for x in plan(df).splitlines()]
    at = next(i for i, x in enumerate(lines) if x.startswith("SortMergeJoin [pin"))
    assert lines[at + 1].startswith("Sort") and lines[at + 2].startswith("Exchange hashpartitioning(pin")
    assert "Window" not in "".join(lines)  # the sale side is a written table by then


def test_statistics_read_only_their_columns(spark, sf_dir):
    s = Study(fixtures.inputs(spark, sf_dir), BASE_YEAR)
    text = plan(s.cod_by_year())
    assert "tax_bill_total" not in text.split("ReadSchema:", 1)[1].split("\n", 1)[0]


def test_large_statistics_write_only_their_columns(spark, sf_dir, distributed, monkeypatch):
    written = []

    def recorded(df, label, **counts):
        written.append((label, df.columns))
        return stage(df, label, **counts)

    stage = study.stage
    monkeypatch.setattr(study, "stage", recorded)
    s = Study(fixtures.inputs(spark, sf_dir), BASE_YEAR)
    narrow = s.prd_by_year().orderBy("year").collect()
    assert [columns for label, columns in written if label == "clean"] == [["year", "av_ratio_mailed", "sale_price_hpi"]]
    # another statistic shares the plan; after keep() all read the whole rows
    plans = dict(s._plans)
    s.cod_by_year()
    assert s._plans == plans and len(plans) == 1
    s.keep()
    n = len(written)
    assert s.prd_by_year().orderBy("year").collect() == narrow and len(written) == n


def test_unknown_table_is_refused():
    with pytest.raises(TypeError):
        Inputs(orders=lambda: None)


def test_calendar_and_cpi(spark):
    rows = {r.year: r.triad_name for r in reassessment_calendar(spark).collect()}
    assert len(rows) == 12 and rows[2011] == "South" and rows[2018] == "City" and rows[2022] == "North"
    assert cpi_index(spark).where("year = 2023").first().cpi == 1.0


def test_study_from_files_writes_every_feed(spark, sf_dir):
    """Tables written to a folder, read back under the declared schemas, to the feeds of all charts."""
    made, folder, out = fixtures.inputs(spark, sf_dir), stage_path(spark, "tables"), stage_path(spark, "feeds")
    for name in ("sales", "assessments", "class_dict", "townships", "appeals", "acs_race", "block_groups", "pin_points"):
        getattr(made, name).write.parquet(f"{folder}/{name}")
    paths = charts.write_feeds(Study(load_inputs(spark, folder), BASE_YEAR), CELL, out)
    assert len(paths) == 35
    direct = Study(made, BASE_YEAR)
    assert spark.read.parquet(paths["prd"]).exceptAll(direct.prd_by_year()).count() == 0
    assert spark.read.parquet(paths["cod"]).count() == direct.cod_by_year().count()
    assert spark.read.parquet(paths["judged"]).where(F.col("band").isNull()).count() == 0


def test_one_triad_is_a_semi_join(spark, sf_dir):
    s = Study(fixtures.inputs(spark, sf_dir), BASE_YEAR)
    every = areas.area_plurality_map(s, CELL).where("triad_name = 'City'").drop("triad_name", "ring")
    one = areas.area_plurality_map(s, CELL, "City")
    assert "LeftSemi" in plan(one)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, one.drop("ring").collect()))

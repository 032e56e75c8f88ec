"""Registered queries against their SQL.

By default the pipelines and a few operators run at sf0.001, and some in the form meant for large data. ORACLE_ALL=1 runs every
entry in both forms, ORACLE_SF picks the data.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from levyscope.registry import ENTRIES, fixtures
from levyscope.plans.study import Study

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHOSEN = [n for n in ENTRIES if n.startswith("Q")] + [
    "S3_csv_to_parquet", "P12_rename_all_regex", "A6_null_profile", "A10_quantile_exact", "A15_ols_interval", "A15_three_sales", "W5_quantile_trim_flags",
    "W7_ntile", "C1_loess_by_group", "C2_stacked_bands", "J9_spatial_within", "D4_area_filter", "D5_assign_nearest",
]
LARGE_FORM = [
    "Q8_outlier_flags", "Q12_price_index_trend", "Q18_cod_by_year", "Q19_prd_by_year", "Q20_prb_by_year", "Q25_area_ratios",
    "A10_quantile_exact", "A15_three_sales", "W7_ntile_quartile", "C1_loess_board", "G2_point_in_polygon", "D1_at_real_coordinates", "D5_assign_nearest",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def text(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def compare(name, spark, sf_dir, duck):
    df = driver.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    res = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in res.fetchall())


@pytest.mark.parametrize("name", list(ENTRIES) if os.environ.get("ORACLE_ALL") else CHOSEN)
def test_matches_sql(name, spark, sf_dir, duck):
    compare(name, spark, sf_dir, duck)


@pytest.mark.parametrize("name", list(ENTRIES) if os.environ.get("ORACLE_ALL") else LARGE_FORM)
def test_large_form_matches_sql(name, spark, sf_dir, duck, distributed):
    compare(name, spark, sf_dir, duck)


def test_every_query_has_sql():
    assert set(ENTRIES) <= set(driver.oracle_sql())


def test_flagship_entry(spark):
    assert driver.entry(spark).columns == ["year", "mean_av", "median_av", "weighted_mean_av", "prd", "n"]


def test_recorded_counts(spark):
    """Row counts of the fixture mapping at sf0.01."""
    study = Study(fixtures.inputs(spark, "/root/testdata/sf0.01"), 2016)
    assert study.rows == 7837
    clean = study.clean()
    assert clean.count() == 5565 and clean.where("triad_name is not null").count() == 3384
    prd = {r.year: round(r.prd, 6) for r in study.prd_by_year().collect()}
    assert (prd[2016], prd[2019], prd[2022]) == (1.611731, 1.438108, 1.507092)

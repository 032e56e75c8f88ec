"""Entries of the single operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from levyscope.functions import scalars as fn
from levyscope.operators import outliers, rank, ratios, regions, shape, shares, spatial
from levyscope.plans import areas, charts, labels, rolls, study
from levyscope.registry.entries import Context, entry
from levyscope.registry.fixtures import CELL, SCHEMAS, TILE, varied_areas
from levyscope.registry.pipelines import BOARD_LABEL, interval_sql
from levyscope.scale import stage, stage_path
from levyscope.sources import readers, schemas, sinks
from levyscope.sources.literals import price_index, reassessment_calendar


def roll(c: Context):
    """Classed assessments with township and triad."""
    known = rolls.with_class(rolls.roll(c.inputs), rolls.labelled_classes(c.inputs))
    return rolls.with_triad(rolls.township_of(known), c.inputs.townships)


def ratio_rows(c: Context):
    """The unflagged base with its measured row count."""
    return c.study.base.df, c.study.rows


# -- sources and sinks

entry(
    "S1_scan_parquet",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
)(
    lambda c: readers.read_table(c.spark, f"{c.sf_dir}/orders.parquet", SCHEMAS["orders"]).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date")
    )
)
entry(
    "S2_scan_sql_extract",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate >= '1998-01-01'",
)(
    lambda c: readers.read_extract(
        c.spark,
        f"{c.sf_dir}/lineitem.parquet",
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
        "l_shipdate >= timestamp_ntz'1998-01-01'",
    )
)


@entry("S3_csv_to_parquet", "SELECT pin, year, sale_date, sale_price, sale_key, '0' AS class, 0 AS township_code FROM sales")
def _(c):
    src, dst = stage_path(c.spark, "csv"), stage_path(c.spark, "ingested")
    columns = [part.split()[0] for part in schemas.SALES.split(", ")]
    c.inputs.sales.select(*columns).write.option("header", True).csv(src)
    return readers.ingest_csv(c.spark, src, dst, schemas.SALES)


entry("S4_lookup_tables", "SELECT reporting_group, triad_name, count(*) AS n FROM roll GROUP BY ALL")(
    lambda c: shares.tally(roll(c), "reporting_group", "triad_name")
)
entry(
    "S5_literal_index",
    """SELECT year, count(*) AS n, any_value(case_shiller) AS case_shiller, any_value(hpi) AS hpi,
       sum(sale_price * hpi) AS sale_price_hpi FROM sales JOIN prices USING (year) GROUP BY year""",
    "sale_price_hpi:2",
)(
    lambda c: c.inputs.sales.join(price_index(c.spark), "year")
    .groupBy("year")
    .agg(
        F.count(F.lit(1)).alias("n"),
        F.first("case_shiller").alias("case_shiller"),
        F.first("hpi").alias("hpi"),
        F.sum(F.col("sale_price") * F.col("hpi")).alias("sale_price_hpi"),
    )
)
entry(
    "S6_generated_calendar",
    """SELECT c.year, c.triad_name, count(r.year) AS n_reassessed, count(r.av_mailed) FILTER (r.av_mailed > 100) AS n_valued
       FROM calendar c LEFT JOIN roll r ON r.year = c.year AND r.triad_name = c.triad_name GROUP BY c.year, c.triad_name""",
)(
    lambda c: reassessment_calendar(c.spark)
    .join(roll(c).select("year", "triad_name", "av_mailed"), ["year", "triad_name"], "left")
    .groupBy("year", "triad_name")
    .agg(F.count("av_mailed").alias("n_reassessed"), F.count_if(F.col("av_mailed") > 100).alias("n_valued"))
)


@entry("S7_scan_long_extract", "SELECT geoid AS GEOID, variable, estimate, summary_est FROM acs_race")
def _(c):
    path = stage_path(c.spark, "long")
    c.inputs.acs_race.write.option("header", True).csv(path)
    return readers.read_long(c.spark, path, schemas.ACS_LONG, "csv")


@entry(
    "S8_polygon_layer",
    """SELECT geoid, n, cx * 0.02::DOUBLE AS xmin, (cx + 1) * 0.02::DOUBLE AS xmax, cy * 0.02::DOUBLE AS ymin,
       (cy + 1) * 0.02::DOUBLE AS ymax FROM tiles""",
    "xmin:6 xmax:6 ymin:6 ymax:6",
)
def _(c):
    path = stage_path(c.spark, "layer")
    c.tiles().write.parquet(path)
    schema = "geoid string, n bigint, ring array<struct<x: double, y: double>>"
    return readers.read_polygons(c.spark, path, schema).drop("ring")


@entry("S9_write_feed", "SELECT * FROM class_year_triad", "av_board:2")
def _(c):
    out, name = stage_path(c.spark, "feeds"), "class_year_triad"
    sinks.write_feed(c.inputs.townships, name, out)  # an older version, which the next one replaces
    sinks.write_feed(rolls.class_year_triad_summary(c.inputs), name, out)
    return sinks.read_feed(c.spark, f"{out}/{name}")


# -- projections, filters, predicates

entry(
    "P1_filter_range", "SELECT pin, year, av_mailed FROM assessments WHERE year >= 2018 AND year <= 2021", "av_mailed:4"
)(lambda c: c.inputs.assessments.where(F.col("year").between(2018, 2021)).select("pin", "year", "av_mailed"))
entry("P2_filter_and", "SELECT pin, year, sale_key FROM sales WHERE year >= 2018 AND sale_price > 100000")(
    lambda c: c.inputs.sales.where((F.col("year") >= 2018) & (F.col("sale_price") > 100000)).select("pin", "year", "sale_key")
)
entry(
    "P3_filter_or_of_ands",
    """SELECT pin, year, triad_name FROM roll WHERE (triad_name = 'City' AND year IN (2018, 2021))
       OR (triad_name = 'North' AND year IN (2016, 2022)) OR (triad_name = 'South' AND year IN (2017, 2020))""",
)(
    lambda c: roll(c)
    .where(labels.own_comparison(F.col("triad_name"), labels.year_label(F.col("year"), labels.COMPARISON, "Before 2015")))
    .select("pin", "year", "triad_name")
)
entry(
    "P4_filter_in_constants",
    """SELECT major_class_type, year, name, value FROM (UNPIVOT tax_base ON av_mailed, av_board, av_certified, av_clerk, tax_bill_total
       INTO NAME name VALUE value) WHERE name IN ('av_mailed', 'av_board', 'tax_bill_total')""",
    "value:2",
)(
    lambda c: shape.unpivot_long(rolls.tax_base(c.inputs), ["major_class_type", "year"], rolls.TAX_BASE).where(
        fn.in_set(F.col("name"), ["av_mailed", "av_board", "tax_bill_total"])
    )
)
entry(
    "P5_filter_in_query",
    "SELECT pin10, geoid FROM pin_area WHERE geoid IN (SELECT geoid FROM plurality WHERE plurality_race = 'Asian/Pacific Islander')",
)(
    lambda c: areas.parcel_areas(c.inputs, CELL).join(
        areas.race_plurality(c.inputs).where(F.col("plurality_race") == "Asian/Pacific Islander"), "geoid", "left_semi"
    )
)
entry("P6_filter_not_null", "SELECT pin, year, triad_name FROM roll WHERE triad_name IS NOT NULL")(
    lambda c: roll(c).where(F.col("triad_name").isNotNull()).select("pin", "year", "triad_name")
)
entry(
    "P7_filter_not_equal",
    """SELECT tax_year, class, township_code, result FROM appeals WHERE class <> 0 AND result <> 'Increase'""",
)(
    lambda c: shape.lower_names(c.inputs.appeals)
    .where((F.col("class") != 0) & (F.col("result") != "Increase"))
    .select("tax_year", "class", "township_code", "result")
)
entry("P8_drop_columns", "SELECT pin, year, sale_date, sale_price, sale_key FROM sales")(
    lambda c: c.inputs.sales.drop("class", "township_code")
)
entry("P9_select_reorder", "SELECT major_class_type, year, av_board, pin_total_count FROM class_year", "av_board:2")(
    lambda c: rolls.class_year_summary(c.inputs).select("major_class_type", "year", "av_board", "pin_total_count")
)
entry(
    "P10_rename",
    "SELECT tax_year, result, assessor_totalvalue AS assessor_total, bor_totalvalue AS bor_total FROM appeals",
    "assessor_total:4 bor_total:4",
)(
    lambda c: shape.lower_names(c.inputs.appeals)
    .select("tax_year", "result", "assessor_totalvalue", "bor_totalvalue")
    .withColumnsRenamed({"assessor_totalvalue": "assessor_total", "bor_totalvalue": "bor_total"})
)
entry(
    "P11_rename_all_lower",
    "SELECT tax_year, class, township_code, result, assessor_totalvalue, bor_totalvalue FROM appeals",
    "assessor_totalvalue:4 bor_totalvalue:4",
)(lambda c: shape.lower_names(c.inputs.appeals))
entry("P12_rename_all_regex", "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_totalprice AS total_price_usd FROM orders")(
    lambda c: shape.clean_names(
        c.table("orders").select("o_orderkey", "o_custkey", "o_totalprice").toDF("order  key", "cust.key", "total/price usd")
    )
)
ACROSS = ["tax_bill_total", "av_mailed", "av_certified", "av_board", "av_clerk"]
entry(
    "P13_across_template",
    "SELECT pin, year, "
    + ", ".join(f"{v} * {s} AS {v}_{s}" for s in ("case_shiller", "hpi") for v in ACROSS)
    + " FROM assessments LEFT JOIN prices USING (year)",
    " ".join(f"{v}_{s}:4" for s in ("case_shiller", "hpi") for v in ACROSS),
)(
    lambda c: shape.adjust(c.inputs.assessments.join(c.inputs.prices, "year", "left"), ACROSS, ["case_shiller", "hpi"]).drop(
        *ACROSS, "tax_code_num", "class", "case_shiller", "hpi"
    )
)
entry(
    "P14_derived_ratio",
    """SELECT pin, year, av_board / av_mailed AS board_mailed_ratio, av_board - av_mailed AS board_mailed_diff,
       (av_board - av_mailed) / av_mailed AS board_mailed_diff_pct, tax_bill_total / av_clerk AS bill_rate FROM assessments""",
    "board_mailed_ratio:7 board_mailed_diff:4 board_mailed_diff_pct:7 bill_rate:7",
)(
    lambda c: c.inputs.assessments.select(
        "pin",
        "year",
        fn.ieee_div(F.col("av_board"), F.col("av_mailed")).alias("board_mailed_ratio"),
        (F.col("av_board") - F.col("av_mailed")).alias("board_mailed_diff"),
        fn.ieee_div(F.col("av_board") - F.col("av_mailed"), F.col("av_mailed")).alias("board_mailed_diff_pct"),
        fn.ieee_div(F.col("tax_bill_total"), F.col("av_clerk")).alias("bill_rate"),
    )
)
entry(
    "P15_case_label",
    """SELECT pin, year, CASE WHEN year BETWEEN 1998 AND 2010 THEN 'Houlihan' WHEN year BETWEEN 2011 AND 2018 THEN 'Berrios'
         WHEN year BETWEEN 2019 AND 2024 THEN 'Kaegi' END AS assessor_term,
       CASE WHEN year IN (2018, 2021) THEN '2018 vs. 2021' WHEN year IN (2017, 2020) THEN '2017 vs. 2020'
         WHEN year IN (2016, 2022) THEN '2016 vs. 2022' ELSE 'Before 2015' END AS comparison_years,
       CASE WHEN major_class_type = 'Residential' THEN 'Residential' ELSE 'Non-residential' END AS res_nonres_label
       FROM roll""",
)(
    lambda c: roll(c).select(
        "pin",
        "year",
        labels.assessor_term(F.col("year")).alias("assessor_term"),
        labels.year_label(F.col("year"), labels.COMPARISON, "Before 2015").alias("comparison_years"),
        "res_nonres_label",
    )
)
entry("P16_constant_column", "SELECT class, year, count(*) AS pin_total_count FROM assessments GROUP BY class, year")(
    lambda c: shares.sum_by(c.inputs.assessments.withColumn("pin_total_count", F.lit(1)), ["class", "year"], ["pin_total_count"])
)

# -- joins

entry("J1_inner_lookup", "SELECT class_char, reporting_group, result, count(*) AS n FROM appeal_base GROUP BY ALL")(
    lambda c: shares.tally(rolls.appeals_base(c.inputs), "class_char", "reporting_group", "result")
)
entry("J2_inner_composite", "SELECT pin, year, av_mailed, sale_price, sale_key FROM base", "av_mailed:4")(
    lambda c: study.sales_ratio_base(c.inputs).select("pin", "year", "av_mailed", "sale_price", "sale_key")
)
entry("J3_left_lookup", "SELECT pin, year, township_code, triad_name FROM roll")(
    lambda c: roll(c).select("pin", "year", "township_code", "triad_name")
)
entry(
    "J4_left_composite",
    'SELECT year, major_class_type, triad_name, pin_total_count, result, "count" FROM rates_triad',
)(
    lambda c: rolls.appeal_rates_triad(c.inputs).select(
        "year", "major_class_type", "triad_name", "pin_total_count", "result", "count"
    )
)
entry("J5_left_index", "SELECT sale_key, year, case_shiller, hpi FROM sales LEFT JOIN prices USING (year)")(
    lambda c: c.inputs.sales.join(c.inputs.prices, "year", "left").select("sale_key", "year", "case_shiller", "hpi")
)
entry(
    "J6_self_join_base",
    """SELECT a.major_class_type, a.year, a.av_board, b.av_board AS av_board_2016, a.av_board / b.av_board AS board_index
       FROM class_year a LEFT JOIN class_year b ON a.major_class_type = b.major_class_type AND b.year = 2016""",
    "av_board:2 av_board_2016:2 board_index:7",
)(
    lambda c: study.index_to_base(
        rolls.class_year_summary(c.inputs), "major_class_type", "year", "av_board", 2016, "board_index"
    ).drop("pin_total_count")
)
entry(
    "J7_left_chain",
    """SELECT g.geoid, n_parcels, plurality_race FROM block_groups g
       LEFT JOIN (SELECT geoid, count(*) AS n_parcels FROM pin_area GROUP BY geoid) a ON g.geoid = a.geoid
       LEFT JOIN plurality p ON g.geoid = p.geoid""",
)(
    lambda c: areas.area_layer(c.inputs)
    .join(shares.tally(areas.parcel_areas(c.inputs, CELL), "geoid", name="n_parcels"), "geoid", "left")
    .join(areas.race_plurality(c.inputs), "geoid", "left")
    .select("geoid", "n_parcels", "plurality_race")
)


@entry(
    "J8_join_model_outputs",
    f"""SELECT year, intercept, est AS slope, lower, upper FROM ({interval_sql("prb_fit", "year", True)})""",
    "intercept:6 slope:6 lower:6 upper:6",
)
def _(c):
    terms = stage(c.study.prb_terms(), "terms").df
    line = ratios.ols_by(terms, "prb_pct_diff", "prb_ln_value", ["year"])
    bounds = ratios.ols_interval(terms, "prb_pct_diff", "prb_ln_value", ["year"]).select("year", "lower", "upper")
    return line.join(bounds, "year", "left")


WITHIN = "(ay > p.y) <> (by_ > p.y) AND p.x < ax + (bx - ax) * (p.y - ay) / (by_ - ay)"
entry(
    "J9_spatial_within",
    f"""SELECT p.pin10, p.x, p.y, geoid FROM (SELECT pin10, longitude AS x, latitude AS y FROM pin_points) p, edges
        WHERE {WITHIN} GROUP BY p.pin10, p.x, p.y, geoid HAVING count(*) % 2 = 1""",
    "x:6 y:6",
)(
    lambda c: spatial.join_within(
        spatial.points_from_lonlat(c.inputs.pin_points), c.inputs.block_groups.select("geoid", "ring"), CELL
    ).drop("ring")
)
entry(
    "J9_areas_of_parts",
    """SELECT pin10, x, y, geoid FROM (
         SELECT *, x / 0.02::DOUBLE - cx AS u, y / 0.02::DOUBLE - cy AS v
         FROM (SELECT pin10, longitude AS x, latitude AS y FROM pin_points) p JOIN tiles
           ON cx = CAST(floor(x / 0.02::DOUBLE) AS BIGINT) AND cy = CAST(floor(y / 0.02::DOUBLE) AS BIGINT))
       WHERE CASE n % 3 WHEN 0 THEN true WHEN 1 THEN NOT (u BETWEEN 0.25 AND 0.75 AND v BETWEEN 0.25 AND 0.75)
         ELSE u < 1.0::DOUBLE / 3 OR u > 2.0::DOUBLE / 3 END
       UNION ALL SELECT pin10, longitude, latitude, 'around' FROM pin_points""",
    "x:6 y:6",
)(
    lambda c: spatial.join_within(
        spatial.points_from_lonlat(c.inputs.pin_points), varied_areas(c.spark, c.sf_dir), TILE
    ).drop("rings")
)

# -- aggregations

entry(
    "A1_sum_many_by",
    "SELECT class, year, sum(av_mailed) AS av_mailed, sum(av_board) AS av_board, sum(tax_bill_total) AS tax_bill_total FROM assessments GROUP BY class, year",
    "av_mailed:2 av_board:2 tax_bill_total:2",
)(lambda c: shares.sum_by(c.inputs.assessments, ["class", "year"], ["av_mailed", "av_board", "tax_bill_total"]))
entry(
    "A2_mixed_summary",
    """SELECT year, reporting_group, count(*) AS "count", sum(sale_price) AS sale_price_sum, avg(av_ratio_mailed) AS av_ratio_mailed,
       avg(sale_price) AS sale_price FROM base GROUP BY year, reporting_group""",
    "sale_price_sum:2 av_ratio_mailed:7 sale_price:4",
)(
    lambda c: ratios.mean_by(
        study.sales_ratio_base(c.inputs), ["year", "reporting_group"], ["av_ratio_mailed", "sale_price"],
        also=[fn.strict_sum(F.col("sale_price")).alias("sale_price_sum")],
    )
)
entry("A3_tally", "SELECT outlier_flag_iaao, count(*) AS n FROM flagged GROUP BY outlier_flag_iaao")(
    lambda c: shares.tally(c.study.flagged(outliers.NO_TRIMS), "outlier_flag_iaao")
)
entry("A4_count_rows", "SELECT year, count(*) AS n FROM sales GROUP BY year")(lambda c: shares.tally(c.inputs.sales, "year"))
entry("A5_distinct_values", "SELECT DISTINCT year FROM base")(
    lambda c: shares.distinct_values(study.sales_ratio_base(c.inputs), "year")
)
NULLED = ["pin", "year", "township_code", "triad_name", "sale_price", "av_mailed", "av_ratio_mailed"]
entry(
    "A6_null_profile",
    " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) FILTER ({n} IS NULL) AS n_null FROM base" for n in NULLED),
)(lambda c: shares.null_profile(study.sales_ratio_base(c.inputs).select(*NULLED)))
entry(
    "A7_mean_skip_null",
    """SELECT r.year, count(*) AS n, avg(s.sale_price) AS sale_price FROM roll r
       LEFT JOIN latest s ON lpad(r.pin, 14, '0') = s.pin AND r.year = s.year GROUP BY r.year""",
    "sale_price:4",
)(
    lambda c: rolls.roll(c.inputs)
    .withColumn("pin", fn.pad_left(F.col("pin"), 14))
    .join(study.latest_sales(c.inputs), ["pin", "year"], "left")
    .groupBy("year")
    .agg(F.count(F.lit(1)).alias("n"), F.avg("sale_price").alias("sale_price"))
)
entry("A8_median", "SELECT class, median(av_mailed) AS av_mailed FROM assessments GROUP BY class", "av_mailed:4")(
    lambda c: outliers.group_median(c.inputs.assessments, "av_mailed", ["class"], "av_mailed")
)
entry(
    "A9_weighted_mean",
    "SELECT year, sum(av_board / av_mailed * av_mailed) / sum(av_mailed) AS board_level FROM assessments GROUP BY year",
    "board_level:7",
)(
    lambda c: c.inputs.assessments.groupBy("year").agg(
        fn.weighted_mean(fn.ieee_div(F.col("av_board"), F.col("av_mailed")), F.col("av_mailed")).alias("board_level")
    )
)
POINTS = [0.25, 0.75, 0.01, 0.02, 0.03, 0.04, 0.05, 0.95, 0.96, 0.97, 0.98, 0.99]
PROBS = {f"q{round(p * 100)}": p for p in POINTS}
entry(
    "A10_quantile_exact",
    "SELECT year, "
    + ", ".join(f"quantile_cont(sale_price, {p}) AS {n}" for n, p in PROBS.items())
    + " FROM sales GROUP BY year",
    " ".join(f"{n}:4" for n in PROBS),
)(lambda c: outliers.group_quantiles(c.inputs.sales, "sale_price", ["year"], PROBS))
CLASS_MEDIAN = "SELECT class, median(av_ratio_mailed) AS med FROM base GROUP BY class"


@entry(
    "A11_cod",
    f"""SELECT class, sum(abs(av_ratio_mailed - med)) / count(*) / any_value(med) AS cod, count(*) AS n
        FROM base JOIN ({CLASS_MEDIAN}) USING (class) GROUP BY class""",
    "cod:7",
)
def _(c):
    df, rows = ratio_rows(c)
    return ratios.cod(df, "av_ratio_mailed", ["class"], rows)


@entry(
    "A12_prd",
    """SELECT class, avg(av_ratio_mailed) AS mean_av, median(av_ratio_mailed) AS median_av,
       sum(av_ratio_mailed * sale_price) / sum(sale_price) AS weighted_mean_av,
       avg(av_ratio_mailed) / (sum(av_ratio_mailed * sale_price) / sum(sale_price)) AS prd, count(*) AS n FROM base GROUP BY class""",
    "mean_av:7 median_av:7 weighted_mean_av:7 prd:7",
)
def _(c):
    df, rows = ratio_rows(c)
    return ratios.prd(df, "av_ratio_mailed", "sale_price", ["class"], rows)


TERMS_SQL = f"""SELECT class, (av_ratio_mailed - med) / med AS prb_pct_diff,
  log2(0.5::DOUBLE * (av_mailed / med) + 0.5::DOUBLE * sale_price) AS prb_ln_value FROM base JOIN ({CLASS_MEDIAN}) USING (class)"""
FIT_SQL = f"""(SELECT class, regr_intercept(prb_pct_diff, prb_ln_value) AS intercept, regr_slope(prb_pct_diff, prb_ln_value) AS est,
  regr_sxx(prb_pct_diff, prb_ln_value) AS sxx, regr_syy(prb_pct_diff, prb_ln_value)
  - regr_sxy(prb_pct_diff, prb_ln_value) * regr_sxy(prb_pct_diff, prb_ln_value) / regr_sxx(prb_pct_diff, prb_ln_value) AS rss,
  count(*) AS n FROM ({TERMS_SQL}) GROUP BY class)"""


def class_terms(c: Context):
    df, rows = ratio_rows(c)
    return ratios.prb_terms(df, "av_ratio_mailed", "av_mailed", "sale_price", ["class"], rows)


entry("A13_prb_transform", TERMS_SQL, "prb_pct_diff:6 prb_ln_value:6")(class_terms)
entry("A14_ols_by_group", f"SELECT class, intercept, est AS slope FROM {FIT_SQL}", "intercept:5 slope:5")(
    lambda c: ratios.ols_by(class_terms(c), "prb_pct_diff", "prb_ln_value", ["class"])
)
entry("A15_ols_interval", interval_sql(FIT_SQL, "class", False), "intercept:5 est:5 lower:5 upper:5")(
    lambda c: ratios.ols_interval(class_terms(c), "prb_pct_diff", "prb_ln_value", ["class"], pool=False)
)
entry("A15_ols_interval_pooled", interval_sql(FIT_SQL, "class", True), "intercept:5 est:5 lower:5 upper:5")(
    lambda c: ratios.ols_interval(class_terms(c), "prb_pct_diff", "prb_ln_value", ["class"], pool=True)
)
# groups of exactly three sales: one degree of freedom each, where the t quantile is farthest from the normal one
FEW_SQL = """(SELECT class, few, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS est, regr_sxx(y, x) AS sxx,
  greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) AS rss, count(*) AS n
  FROM (SELECT class, few, (av_ratio_mailed - med) / med AS y, log2(0.5::DOUBLE * (av_mailed / med) + 0.5::DOUBLE * sale_price) AS x
    FROM (SELECT *, median(av_ratio_mailed) OVER (PARTITION BY class, few) AS med FROM (SELECT *, sale_key % 331 AS few FROM base)))
  GROUP BY class, few HAVING count(*) = 3)"""


@entry("A15_three_sales", interval_sql(FEW_SQL, "class, few", False), "intercept:3 est:3 lower:3 upper:3")
def _(c):
    df, rows = ratio_rows(c)
    by = ["class", "few"]
    terms = ratios.prb_terms(df.withColumn("few", F.col("sale_key") % 331), "av_ratio_mailed", "av_mailed", "sale_price", by, rows)
    return ratios.ols_interval(terms, "prb_pct_diff", "prb_ln_value", by, pool=False).where("n = 3")


entry(
    "A16_pivot_wide",
    "SELECT year, "
    + ", ".join(
        f"max(CASE WHEN major_class_type = '{m}' THEN {v} END) AS {v}_{m}"
        for v in ("pin_total_count", "av_board")
        for m in ("Residential", "Commercial")
    )
    + " FROM class_year GROUP BY year",
    "av_board_Residential:2 av_board_Commercial:2",
)(
    lambda c: shape.pivot_wide(
        rolls.class_year_summary(c.inputs), ["year"], "major_class_type", ["Residential", "Commercial"],
        ["pin_total_count", "av_board"],
    )
)
entry(
    "A17_unpivot_long",
    """SELECT year, pin, name, value FROM (UNPIVOT (SELECT year, pin, av_mailed, av_board, tax_bill_total FROM assessments)
       ON av_mailed, av_board, tax_bill_total INTO NAME name VALUE value)""",
    "value:4",
)(
    lambda c: shape.unpivot_long(
        c.inputs.assessments.select("year", "pin", "av_mailed", "av_board", "tax_bill_total"),
        ["year", "pin"], ["av_mailed", "av_board", "tax_bill_total"],
    )
)

# -- grouped mutate

entry("W1_latest_per_key", "SELECT pin, year, sale_key, sale_price FROM latest")(
    lambda c: study.latest_sales(c.inputs).select("pin", "year", "sale_key", "sale_price")
)
entry("W2_dedup_first", "SELECT pin10, x AS longitude, y AS latitude FROM one_point", "longitude:6 latitude:6")(
    lambda c: rank.dedup_first(c.inputs.pin_points, ["pin10"], ["longitude", "latitude"])
)
entry(
    "W3_top1_category",
    """SELECT geoid, race, estimate FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY estimate / summary_est DESC, race) AS rn
       FROM race) WHERE rn = 1""",
)(
    lambda c: rank.top_category(
        areas.race_by_area(c.inputs).withColumn("shr", fn.ieee_div(F.col("estimate"), F.col("summary_est"))), "geoid", "shr", "race"
    ).select("geoid", "race", "estimate")
)
# the next three and the tiles below run the distributed form: no row count is given
entry("W4_iqr_fence_flag", "SELECT pin, year, outlier_flag_iaao FROM flagged")(
    lambda c: outliers.iqr_flag(c.study.base.df, "av_ratio_mailed", study.FENCE_GROUP).select(
        "pin", "year", "outlier_flag_iaao"
    )
)
TRIM_COLUMNS = [outliers.trim_names(p)[2] for p in outliers.TRIMS]
entry("W5_quantile_trim_flags", f"SELECT pin, year, {', '.join(TRIM_COLUMNS)} FROM flagged")(
    lambda c: outliers.trim_flags(c.study.base.df, "av_ratio_mailed", study.FENCE_GROUP).select("pin", "year", *TRIM_COLUMNS)
)
entry(
    "W6_zscore_by_group",
    """SELECT sale_key, year, abs((sale_price - avg(sale_price) OVER (PARTITION BY year)) / stddev_samp(sale_price) OVER (PARTITION BY year)) AS zscore
       FROM sales""",
    "zscore:6",
)(lambda c: outliers.zscore_by_group(c.inputs.sales, "sale_price", ["year"]).select("sale_key", "year", "zscore"))
entry(
    "W7_ntile",
    """SELECT sale_key, year, CAST(ntile(100) OVER (PARTITION BY year ORDER BY sale_price, sale_key) AS INTEGER) AS sales_ntile FROM sales""",
)(
    lambda c: rank.ntile(c.inputs.sales, "sales_ntile", 100, ["year"], "sale_price", "sale_key").select(
        "sale_key", "year", "sales_ntile"
    )
)
entry(
    "W7_ntile_quartile",
    """SELECT pin, year, CAST(ntile(4) OVER (PARTITION BY year, reporting_group ORDER BY sale_price, pin) AS INTEGER) AS sales_ntile FROM base""",
)(
    lambda c: rank.ntile(
        c.study.base.df, "sales_ntile", 4, ["year", "reporting_group"], "sale_price", "pin", c.study.rows
    ).select("pin", "year", "sales_ntile")
)
entry(
    "W8_partition_median",
    """SELECT pin, year, av_mailed - median(av_mailed) OVER (PARTITION BY year) AS deviation FROM assessments""",
    "deviation:4",
)(
    lambda c: ratios.with_median(c.inputs.assessments, "av_mailed", ["year"], "med").select(
        "pin", "year", (F.col("av_mailed") - F.col("med")).alias("deviation")
    )
)
entry(
    "W9_share_of_total",
    """SELECT pin, year, av_mailed / sum(av_mailed) OVER (PARTITION BY year) AS av_mailed_share,
       av_board / sum(av_board) OVER (PARTITION BY year) AS av_board_share FROM assessments""",
    "av_mailed_share:9 av_board_share:9",
)(
    lambda c: shares.share_of_total(c.inputs.assessments, ["av_mailed", "av_board"], ["year"]).select(
        "pin", "year", "av_mailed_share", "av_board_share"
    )
)

# -- order

entry(
    "O1_descending_rank",
    """SELECT pin, sale_key, sale_price FROM (SELECT *, row_number() OVER (PARTITION BY pin ORDER BY sale_price DESC, sale_key DESC) AS rn
       FROM sales) WHERE rn = 1""",
)(lambda c: rank.latest_per_key(c.inputs.sales, ["pin"], "sale_price", "sale_key").select("pin", "sale_key", "sale_price"))
entry(
    "O2_ordered_category",
    """SELECT pin, year, CASE WHEN reporting_group IN ('Single-Family', 'Multi-Family', 'Condominium') THEN reporting_group END AS reporting_group,
       CASE reporting_group WHEN 'Single-Family' THEN 1 WHEN 'Multi-Family' THEN 2 WHEN 'Condominium' THEN 3 END AS reporting_group_ord
       FROM roll""",
)(
    lambda c: shape.ordered_category(roll(c), "reporting_group", labels.REPORTING_GROUPS).select(
        "pin", "year", "reporting_group", "reporting_group_ord"
    )
)

# -- scalar functions

entry("F1_pad_left", "SELECT sale_key, CASE WHEN length(pin) < 14 THEN lpad(pin, 14, '0') ELSE pin END AS pin FROM sales")(
    lambda c: c.inputs.sales.select("sale_key", fn.pad_left(F.col("pin"), 14).alias("pin"))
)
entry("F2_substring", "SELECT pin, year, substr(tax_code_num, 1, 2) AS township_code, substr(pin, 1, 10) AS pin10 FROM assessments")(
    lambda c: c.inputs.assessments.select(
        "pin", "year", F.substring("tax_code_num", 1, 2).alias("township_code"), F.substring("pin", 1, 10).alias("pin10")
    )
)
entry("F3_parse_date", "SELECT sale_key, CAST(try_strptime(sale_date, '%B %d %Y') AS DATE) AS sold FROM sales")(
    lambda c: c.inputs.sales.select("sale_key", fn.month_date(F.col("sale_date")).cast("date").alias("sold"))
)
entry(
    "F4_number_to_code",
    """SELECT class, CAST(CAST(CASE WHEN class >= 1000 THEN class / 100 ELSE class END AS BIGINT) AS VARCHAR) AS class_char, count(*) AS n
       FROM appeals GROUP BY ALL""",
)(
    lambda c: shares.tally(
        shape.lower_names(c.inputs.appeals).withColumn("class_char", fn.class_code(F.col("class"))), "class", "class_char"
    )
)
entry(
    "F5_to_number",
    """SELECT sale_key, TRY_CAST(right(sale_date, 4) AS DOUBLE) AS year_number, TRY_CAST(left(sale_date, 3) AS DOUBLE) AS not_a_number,
       CAST(year AS VARCHAR) AS year_text FROM sales""",
)(
    lambda c: c.inputs.sales.select(
        "sale_key",
        F.right("sale_date", F.lit(4)).try_cast("double").alias("year_number"),
        F.left("sale_date", F.lit(3)).try_cast("double").alias("not_a_number"),
        F.col("year").cast("string").alias("year_text"),
    )
)
entry("F6_concat", "SELECT pin, year, coalesce(triad_name, 'NA') || ' ' || CAST(year AS VARCHAR) AS triad_year FROM roll")(
    lambda c: roll(c).select("pin", "year", fn.paste(F.col("triad_name"), F.col("year")).alias("triad_year"))
)
entry(
    "F7_abs_log",
    """SELECT c_custkey, abs(c_acctbal) AS size, ln(abs(c_acctbal) + 1) AS log_size, ln(abs(c_acctbal) + 1) / ln(2) AS log2_size,
       log2(abs(c_acctbal) + 1) AS log2_direct FROM customer""",
    "log_size:6 log2_size:6 log2_direct:6",
)(
    lambda c: c.table("customer").select(
        "c_custkey",
        F.abs("c_acctbal").alias("size"),
        F.ln(F.abs("c_acctbal") + 1).alias("log_size"),
        (F.ln(F.abs("c_acctbal") + 1) / F.ln(F.lit(2.0))).alias("log2_size"),
        F.log2(F.abs("c_acctbal") + 1).alias("log2_direct"),
    )
)
entry(
    "F8_safe_log10",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN greatest(log10(c_acctbal), 1) ELSE 1 END AS log_balance FROM customer""",
    "log_balance:6",
)(lambda c: c.table("customer").select("c_custkey", fn.safe_log10(F.col("c_acctbal")).alias("log_balance")))
entry(
    "F9_null_chain",
    """SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, coalesce(nullif(l_discount, 0), -1) AS discount_filled,
       CASE WHEN l_tax > 0.05 THEN 'high' ELSE 'low' END AS tax_band FROM lineitem""",
)(
    lambda c: c.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.lit(-1.0)).alias("discount_filled"),
        F.when(F.col("l_tax") > 0.05, "high").otherwise("low").alias("tax_band"),
    )
)
entry(
    "F10_case_fold",
    r"SELECT c_custkey, lower(c_name) AS name, regexp_replace(lower(c_name), '\s+|\.|/|#', '_', 'g') AS slug FROM customer",
)(
    lambda c: c.table("customer").select(
        "c_custkey",
        F.lower("c_name").alias("name"),
        F.regexp_replace(F.lower("c_name"), r"\s+|\.|/|#", "_").alias("slug"),
    )
)
entry(
    "F11_percent_label",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(round_even(l_discount * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS label FROM lineitem""",
)(lambda c: c.table("lineitem").select("l_orderkey", "l_linenumber", fn.percent_label(F.col("l_discount")).alias("label")))
entry(
    "F12_signif_label",
    """SELECT o_orderkey, '$' || CASE WHEN s % 1 = 0 THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE CAST(s AS VARCHAR) END || 'B' AS label
       FROM (SELECT o_orderkey, round(round_even(v / m, 0) * m, 6) AS s
             FROM (SELECT *, pow(10, floor(log10(abs(v))) - 1) AS m FROM (SELECT o_orderkey, o_totalprice * 1e4 / 1e9 AS v FROM orders)))""",
)(lambda c: c.table("orders").select("o_orderkey", fn.billions_label(F.col("o_totalprice") * 1e4).alias("label")))
entry(
    "F13_clamp",
    "SELECT pin, year, least(greatest(tax_bill_total / av_mailed, 0.2), 0.5) AS fill FROM assessments",
    "fill:7",
)(
    lambda c: c.inputs.assessments.select(
        "pin", "year", fn.squish(fn.ieee_div(F.col("tax_bill_total"), F.col("av_mailed")), 0.2, 0.5).alias("fill")
    )
)
entry(
    "F14_censor",
    "SELECT pin, year, sale_price, av_ratio_mailed FROM base WHERE sale_price BETWEEN 0 AND 300000 AND av_ratio_mailed BETWEEN 0 AND 0.3",
    "av_ratio_mailed:7",
)(
    lambda c: study.sales_ratio_base(c.inputs)
    .where(fn.censor(F.col("sale_price"), F.col("av_ratio_mailed"), (0.0, 300_000.0), (0.0, 0.3)))
    .select("pin", "year", "sale_price", "av_ratio_mailed")
)

# -- tables behind the charts


def loess_sql(points: str, keys: str, y: str, span: float) -> str:
    """Direct local quadratic fit: bandwidth by sorting the distances of every grid point."""
    k = ", ".join(f"p.{c}" for c in keys.split(", "))
    on = " AND ".join(f"p.{c} = g.{c}" for c in keys.split(", "))
    scale = max(span, 1.0)
    return f"""
    WITH p AS ({points}),
    ends AS (SELECT {keys}, min(sale_price_hpi) AS lo, max(sale_price_hpi) AS hi, count(*) AS n FROM p GROUP BY {keys}),
    g AS (SELECT *, lo + (hi - lo) * CAST(grid AS DOUBLE) / 79 AS x0 FROM ends, range(80) AS r(grid)),
    d AS (SELECT {k}, g.grid, g.x0, p.sale_price_hpi - g.x0 AS dx, p.y, p.w,
            row_number() OVER (PARTITION BY {k}, g.grid ORDER BY abs(p.sale_price_hpi - g.x0)) AS near,
            least(floor(g.n * {span}::DOUBLE + 1e-5), g.n) AS k
          FROM p JOIN g ON {on}),
    h AS (SELECT *, max(CASE WHEN near = k THEN abs(dx) END) OVER (PARTITION BY {keys}, grid) * {scale}::DOUBLE AS h FROM d),
    u AS (SELECT *, dx / h AS u, w * pow(1 - pow(abs(dx / h), 3), 3) AS t FROM h WHERE h > 0 AND abs(dx) < h),
    m AS (SELECT {keys}, grid, any_value(x0) AS x0, sum(t) AS a, sum(t * u) AS b, sum(t * u * u) AS c, sum(t * u * u * u) AS d,
            sum(t * u * u * u * u) AS e, sum(t * y) AS y0, sum(t * u * y) AS y1, sum(t * u * u * y) AS y2
          FROM u GROUP BY {keys}, grid)
    SELECT {keys}, CAST(grid AS INTEGER) AS grid, x0 AS sale_price_hpi,
      CASE WHEN a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c) > 1e-12::DOUBLE * a * a * a THEN
        (y0 * (c * e - d * d) - b * (y1 * e - d * y2) + c * (y1 * d - c * y2))
        / (a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)) END AS {y}
    FROM m"""


AXES = "sale_price_hpi BETWEEN 0 AND 1000000 AND"
entry(
    "C1_loess_by_group",
    loess_sql(
        f'SELECT *, av_ratio_mailed AS y, "count" AS w FROM profile_county WHERE {AXES} av_ratio_mailed BETWEEN 0 AND 0.3',
        "reporting_group, assessor_term", "av_ratio_mailed", 0.75,
    ),
    "sale_price_hpi:3 av_ratio_mailed:6",
)(lambda c: charts.county_curves(c.study))
entry(
    "C1_loess_total",
    loess_sql(
        f'SELECT *, av_ratio_mailed AS y, "count" AS w FROM profile_county WHERE {AXES} av_ratio_mailed BETWEEN 0 AND 0.3',
        "assessor_term", "av_ratio_mailed", 0.75,
    ),
    "sale_price_hpi:3 av_ratio_mailed:6",
)(lambda c: charts.county_total_curves(c.study))
entry(
    "C1_loess_board",
    loess_sql(
        f"""SELECT year, sale_price_hpi, value AS y, "count" AS w FROM board_long
            WHERE name = 'assessed_value_board_mailed_diff' AND {AXES} value BETWEEN -15000 AND 10""",
        "year", "value", 1.0,
    ),
    "sale_price_hpi:3 value:3",
)(lambda c: charts.board_curves(c.study))
entry(
    "C1_loess_board_pct",
    loess_sql(
        f"""SELECT year, sale_price_hpi, value AS y, "count" AS w FROM board_long
            WHERE name = 'assessed_value_board_mailed_diff_pct' AND {AXES} value BETWEEN -0.2 AND 0""",
        "year", "value", 1.0,
    ),
    "sale_price_hpi:3 value:6",
)(lambda c: charts.board_curves(c.study, "assessed_value_board_mailed_diff_pct"))
for _triad, _years in labels.TRIAD_COMPARISON.items():
    entry(
        f"C1_loess_{_triad.lower()}",
        loess_sql(
            f"""SELECT *, av_ratio_mailed AS y, "count" AS w FROM profile_triad WHERE triad_name = '{_triad}'
                AND comparison_years = '{_years}' AND {AXES} av_ratio_mailed BETWEEN 0 AND 0.3""",
            "reporting_group, assessor_term_year", "av_ratio_mailed", 0.75,
        ),
        "sale_price_hpi:3 av_ratio_mailed:6",
    )(lambda c, triad=_triad: charts.triad_curves(c.study, triad))
BANDS = """SELECT {by} year, result, ratio, sum(ratio) OVER (PARTITION BY {by} year ORDER BY result DESC) AS upper,
  sum(ratio) OVER (PARTITION BY {by} year ORDER BY result DESC) - ratio AS lower FROM {t}
  WHERE major_class_type = '{kind}' AND result <> 'Increase'"""
entry("C2_stacked_bands", BANDS.format(by="", t="rates", kind="Residential"), "ratio:7 upper:7 lower:7")(
    lambda c: charts.appeal_bands(rolls.appeal_rates(c.inputs), "Residential", [])
)
entry("C2_stacked_bands_triad", BANDS.format(by="triad_name,", t="rates_triad", kind="Residential"), "ratio:7 upper:7 lower:7")(
    lambda c: charts.appeal_bands(rolls.appeal_rates_triad(c.inputs), "Residential", ["triad_name"])
)
entry("C2_stacked_bands_commercial", BANDS.format(by="", t="rates", kind="Commercial"), "ratio:7 upper:7 lower:7")(
    lambda c: charts.appeal_bands(rolls.appeal_rates(c.inputs), "Commercial", [])
)
entry("C2_stacked_bands_triad_commercial", BANDS.format(by="triad_name,", t="rates_triad", kind="Commercial"), "ratio:7 upper:7 lower:7")(
    lambda c: charts.appeal_bands(rolls.appeal_rates_triad(c.inputs), "Commercial", ["triad_name"])
)
entry(
    "C3_faceted_slice_triad",
    "SELECT * FROM profile_triad WHERE triad_name = 'City' AND comparison_years = '2018 vs. 2021'",
    "av_ratio_mailed:7 sale_price:4 sale_price_hpi:4",
)(lambda c: charts.triad_slice(c.study, "City"))
entry(
    "C3_faceted_slice_board",
    f"SELECT *, {BOARD_LABEL} AS name_label FROM board_long WHERE name = 'assessed_value_board_mailed_diff_pct'",
    "sale_price:4 sale_price_hpi:4 value:7",
)(lambda c: charts.board_slice(c.study, "assessed_value_board_mailed_diff_pct"))
entry(
    "C3_faceted_slice_map",
    """SELECT geoid, year, av_ratio_mailed, least(greatest(av_ratio_mailed, 0), 0.2) AS fill FROM area_ratios
       WHERE assessor_term = 'Kaegi' AND triad_name = 'City'""",
    "av_ratio_mailed:7 fill:7",
)(
    lambda c: charts.map_slice(areas.area_ratios(c.study, CELL), "Kaegi", "City").select(
        "geoid", "year", "av_ratio_mailed", "fill"
    )
)
entry(
    "C3_share_labels",
    """SELECT *, CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS label FROM share_long
       WHERE major_class_type = 'Residential'""",
    "value:7",
)(lambda c: charts.share_labels(c.inputs, "Residential"))
entry(
    "C3_share_labels_commercial",
    """SELECT *, CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS label FROM share_long
       WHERE major_class_type = 'Commercial'""",
    "value:7",
)(lambda c: charts.share_labels(c.inputs, "Commercial"))
for _kind in ("Residential", "Commercial"):
    entry(
        f"C3_amount_labels_{_kind.lower()}",
        f"""SELECT * EXCLUDE (s, p), '$' || CASE WHEN s IS NULL THEN NULL WHEN s % 1 = 0 THEN CAST(CAST(s AS BIGINT) AS VARCHAR)
              ELSE CAST(s AS VARCHAR) END || 'B' AS label
            FROM (SELECT *, CASE WHEN value = 0 THEN 0::DOUBLE
                    WHEN p < 0 THEN round_even(value / 1e9 * pow(10, -p), 0) / pow(10, -p)
                    ELSE round_even(value / 1e9 / pow(10, p), 0) * pow(10, p) END AS s
                  FROM (SELECT *, floor(log10(abs(nullif(value, 0) / 1e9))) - 1 AS p FROM tax_long WHERE major_class_type = '{_kind}'))""",
        "value:2",
    )(lambda c, kind=_kind: charts.amount_labels(c.inputs, kind))
JUDGE = "CASE WHEN {v} < {lo} THEN 'below' WHEN {v} <= {hi} THEN 'within' ELSE 'above' END"
entry(
    "C4_target_bands",
    f"""SELECT year, 'cod' AS statistic, cod AS value, {JUDGE.format(v='cod', lo=0.05, hi=0.15)} AS band FROM cod
        UNION ALL SELECT year, 'prd', prd, {JUDGE.format(v='prd', lo=0.98, hi=1.03)} FROM prd
        UNION ALL SELECT year, 'prb', est, {JUDGE.format(v='est', lo=-0.05, hi=0.05)} FROM prb_fit""",
    "value:6",
)(lambda c: charts.judged(c.study))

# -- spatial

entry("G1_points_from_lonlat", "SELECT pin10, longitude AS x, latitude AS y FROM pin_points", "x:6 y:6")(
    lambda c: spatial.points_from_lonlat(c.inputs.pin_points)
)
entry(
    "G2_point_in_polygon",
    f"""SELECT p.pin10, p.x, p.y, geoid, count(*) FILTER ({WITHIN}) % 2 = 1 AS within
        FROM (SELECT pin10, longitude AS x, latitude AS y FROM pin_points) p, edges
        GROUP BY p.pin10, p.x, p.y, geoid
        HAVING p.x BETWEEN min(least(ax, bx)) AND max(greatest(ax, bx)) AND p.y BETWEEN min(least(ay, by_)) AND max(greatest(ay, by_))""",
    "x:6 y:6",
)(
    lambda c: spatial.box_tests(
        spatial.points_from_lonlat(c.inputs.pin_points), c.inputs.block_groups.select("geoid", "ring"), CELL
    )
)
entry("G3_drop_geometry", "SELECT geoid, category, n FROM tiles")(lambda c: spatial.drop_geometry(c.tiles()))
entry("G4_pin_to_area", "SELECT pin10, geoid FROM pin_area")(
    lambda c: spatial.pin_to_area(c.inputs.pin_points, c.inputs.block_groups, spatial.cell_size(c.inputs.block_groups))
)

# -- regions

entry("D1_shared_edges", "SELECT a, b, category, category_b FROM links", regions=True)(
    lambda c: regions.shared_edges(c.tiles(), ["category"])
)
PARTS_SQL = """SELECT * FROM (WITH e AS (SELECT geoid, least(ax, bx) AS x0, greatest(ax, bx) AS x1, least(ay, by_) AS y0, greatest(ay, by_) AS y1 FROM edges)
       SELECT DISTINCT p.geoid AS a, q.geoid AS b FROM e p JOIN e q ON p.geoid < q.geoid AND (
         (p.x1 - p.x0 < 1e-9 AND q.x1 - q.x0 < 1e-9 AND abs(p.x0 - q.x0) < 1e-9 AND least(p.y1, q.y1) - greatest(p.y0, q.y0) > 1e-9)
         OR (p.y1 - p.y0 < 1e-9 AND q.y1 - q.y0 < 1e-9 AND abs(p.y0 - q.y0) < 1e-9 AND least(p.x1, q.x1) - greatest(p.x0, q.x0) > 1e-9)))"""
entry("D1_parts_of_edges", PARTS_SQL)(lambda c: regions.shared_edges(c.inputs.block_groups))


def moved(layer, dx: float, dy: float):
    """The layer (geoid, ring) at another place."""
    there = F.transform("ring", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    return layer.select("geoid", there.alias("ring"))


entry("D1_at_real_coordinates", "SELECT a, b FROM links", regions=True)(lambda c: regions.shared_edges(moved(c.tiles(), -87.0, 42.0)))
entry("D2_dissolve_components", "SELECT geoid, category, cluster_id FROM clustered", regions=True)(
    lambda c: regions.dissolve(c.tiles(), "category").select("geoid", "category", "cluster_id")
)
@entry(
    "D2_permuted_ids",
    "SELECT reverse(geoid) AS id, min(reverse(geoid)) OVER (PARTITION BY cluster_id) AS cluster_id FROM clustered",
    regions=True,
)
def _(c):
    tiles = c.tiles()
    same = regions.shared_edges(tiles, ["category"]).where("category = category_b")
    return regions.components(
        tiles.select(F.reverse("geoid").alias("id")), same.select(F.reverse("a").alias("a"), F.reverse("b").alias("b"))
    )


entry(
    "D3_area_of_parts",
    """SELECT geoid, CASE n % 3 WHEN 0 THEN 4e-4::DOUBLE WHEN 1 THEN 3e-4::DOUBLE ELSE 8e-4::DOUBLE / 3 END AS area FROM tiles
       UNION ALL SELECT 'around', 400.0::DOUBLE""",
    "area:8",
)(lambda c: regions.with_area(varied_areas(c.spark, c.sf_dir)).select("geoid", "area"))
entry("D3_area", "SELECT geoid, category, area FROM clustered", "area:9", regions=True)(
    lambda c: regions.with_area(c.tiles()).select("geoid", "category", "area")
)
entry(
    "D3_cluster_area",
    "SELECT cluster_id, category, area, cx, cy FROM cluster_area",
    "area:8 cx:7 cy:7",
    regions=True,
)(lambda c: regions.cluster_areas(regions.dissolve(c.tiles(), "category"), "category"))
entry("D4_area_filter", "SELECT cluster_id, category, area, area_share FROM kept", "area:8 area_share:7", regions=True)(
    lambda c: regions.area_filter(regions.cluster_areas(regions.dissolve(c.tiles(), "category"), "category"), "category").drop("cx", "cy")
)


ASSIGNED = """SELECT t.geoid, coalesce(own.cluster_id, near.cluster_id) AS cluster_id, coalesce(own.category, near.category) AS category
       FROM clustered t LEFT JOIN kept own ON own.cluster_id = t.cluster_id
       JOIN (SELECT geoid, c.cluster_id, c.category,
               row_number() OVER (PARTITION BY geoid ORDER BY CAST(pow(c.cx - mx, 2) + pow(c.cy - my, 2) AS FLOAT), c.cluster_id) AS rn
             FROM clustered, kept c) near ON near.geoid = t.geoid AND near.rn = 1"""


def assigned(c: Context):
    clustered = regions.dissolve(c.tiles(), "category")
    kept = regions.area_filter(regions.cluster_areas(clustered, "category"), "category")
    return regions.assign_nearest(clustered, kept, "category")


entry("D5_assign_nearest", ASSIGNED, regions=True)(assigned)
entry(
    "D6_redissolve",
    f"""SELECT geoid, category, cluster_id, CAST(dense_rank() OVER (PARTITION BY category ORDER BY cluster_id) AS INTEGER) AS cluster_no
        FROM (
          WITH RECURSIVE asg AS ({ASSIGNED}),
          same AS (SELECT l.a, l.b FROM links l JOIN asg p ON p.geoid = l.a JOIN asg q ON q.geoid = l.b WHERE p.category = q.category),
          again AS (SELECT geoid AS id, geoid AS seen FROM asg
            UNION SELECT w.id, CASE WHEN l.a = w.seen THEN l.b ELSE l.a END FROM again w JOIN same l ON l.a = w.seen OR l.b = w.seen)
          SELECT asg.geoid, asg.category, g.cluster_id
          FROM asg JOIN (SELECT id, min(seen) AS cluster_id FROM again GROUP BY id) g ON g.id = asg.geoid)""",
    regions=True,
)(lambda c: regions.redissolve(c.tiles(), assigned(c), "category").select("geoid", "category", "cluster_id", "cluster_no"))

# -- checks the study makes on its inputs

entry(
    "K1_no_four_digit_class",
    "SELECT count(*) AS n FROM appeals WHERE tax_year >= 2006 AND class <> 0 AND class BETWEEN 1000 AND 9999",
)(lambda c: rolls.bad_appeal_classes(c.inputs).agg(F.count(F.lit(1)).alias("n")))

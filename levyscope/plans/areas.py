"""Small-area pipelines: census groups, parcels in areas, area ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.functions.scalars import ieee_div
from levyscope.operators.rank import top_category
from levyscope.operators.shape import clean_names, lower_names, pivot_wide, relabel
from levyscope.operators.shares import sum_by
from levyscope.operators.spatial import pin_to_area
from levyscope.plans import labels
from levyscope.plans.inputs import Inputs
from levyscope.plans.study import VALUES, Study

AREA_KEYS = ["year", "assessor_term", "comparison_years", "assessor_term_year", "triad_name"]
AREA_VALUES = [f"{c}_hpi" for c in VALUES]


def race_by_area(inputs: Inputs) -> DataFrame:
    named = lower_names(inputs.acs_race).withColumn("race", relabel(F.col("variable"), labels.RACES, ""))
    return sum_by(named, ["geoid", "race", "summary_est"], ["estimate"])


def race_wide(inputs: Inputs) -> DataFrame:
    shares = race_by_area(inputs).withColumn("shr", ieee_div(F.col("estimate"), F.col("summary_est")))
    wide = pivot_wide(shares, ["geoid", "summary_est"], "race", labels.RACE_NAMES, ["shr", "estimate"])
    return clean_names(lower_names(wide))


def race_plurality(inputs: Inputs) -> DataFrame:
    shares = race_by_area(inputs).withColumn("plurality_race_share", ieee_div(F.col("estimate"), F.col("summary_est")))
    top = top_category(shares, "geoid", "plurality_race_share", "race", also=F.col("estimate") > 0)
    return top.select(
        "geoid",
        F.col("race").alias("plurality_race"),
        F.col("estimate").alias("plurality_race_population"),
        "plurality_race_share",
    )


def area_layer(inputs: Inputs) -> DataFrame:
    """Polygons; the estimate carried with them is median household income."""
    return inputs.block_groups.withColumnRenamed("estimate", "median_income")


def parcel_areas(inputs: Inputs, cell: float) -> DataFrame:
    return pin_to_area(inputs.pin_points, inputs.block_groups, cell)


def area_sums(study: Study, cell: float) -> DataFrame:
    """Adjusted values summed by area, year, term and triad, each triad in its own compared years.

    The sales are summed per parcel block first: many units share one block, and the join then sees each block once per
    year. The filter uses grouping keys only, so it stands before the sums.
    """
    own = labels.own_comparison(F.col("triad_name"), F.col("comparison_years"))
    columns = tuple(dict.fromkeys(["pin", "year", "triad_name", "comparison_years", *AREA_KEYS, *AREA_VALUES]))
    sales = study.clean(columns=columns).where((F.col("year") >= 2016) & own).withColumn("pin10", F.substring("pin", 1, 10))
    blocks = sum_by(sales, ["pin10", *AREA_KEYS], AREA_VALUES)
    located = blocks.join(parcel_areas(study.inputs, cell), "pin10", "left")
    sums = sum_by(located, ["geoid", *AREA_KEYS], AREA_VALUES)
    price, mailed, board = F.col("sale_price_hpi"), F.col("av_mailed_hpi"), F.col("av_board_hpi")
    return sums.withColumns(
        {
            "av_ratio_mailed": ieee_div(mailed, price),
            "av_ratio_board": ieee_div(board, price),
            "av_board_mailed_diff": board - mailed,
        }
    )


def area_ratios(study: Study, cell: float) -> DataFrame:
    """Every polygon with its sums (missing where no sale) and its largest population group."""
    layer = area_layer(study.inputs)
    return layer.join(area_sums(study, cell), "geoid", "left").join(race_plurality(study.inputs), "geoid", "left")


def area_plurality(inputs: Inputs) -> DataFrame:
    return area_layer(inputs).join(race_plurality(inputs), "geoid", "left")


def triad_areas(study: Study, cell: float) -> DataFrame:
    """(triad, area) pairs with at least one sale."""
    return area_sums(study, cell).where("geoid is not null and triad_name is not null").select("triad_name", "geoid").distinct()


def area_plurality_map(study: Study, cell: float, triad: str | None = None) -> DataFrame:
    """Areas with a known largest group, limited to the areas of one triad, or each triad's areas under its name."""
    known = area_plurality(study.inputs).where(F.col("plurality_race").isNotNull())
    areas = triad_areas(study, cell)
    if triad is not None:
        return known.join(areas.where(F.col("triad_name") == triad), "geoid", "left_semi")
    return known.join(areas, "geoid", "inner")  # pairs are distinct: one row per triad an area belongs to

"""The table behind each chart: row slices, smoothed curves, stacked bands and judged statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.functions.scalars import billions_label, censor, percent_label, squish
from levyscope.operators.ratios import TARGETS, classify
from levyscope.operators.shares import stack
from levyscope.operators.smooth import loess_by
from levyscope.plans import areas, labels, rolls
from levyscope.plans.study import Study
from levyscope.scale import stage
from levyscope.sources.literals import reassessment_calendar
from levyscope.sources.sinks import write_feed

# Axis ranges
PRICE_RANGE = (0.0, 1_000_000.0)
RATIO_RANGE = (0.0, 0.3)
REDUCTION_RANGE = (-15_000.0, 10.0)
REDUCTION_PCT_RANGE = (-0.2, 0.0)
MAP_RANGE = (0.0, 0.2)


def _on_axes(df: DataFrame, y: str, ylim: tuple[float, float]) -> DataFrame:
    """Points outside the axes are gone before smoothing."""
    return df.where(censor(F.col("sale_price_hpi"), F.col(y), PRICE_RANGE, ylim))


def _curve(df: DataFrame, y: str, ylim, by: list[str], span: float) -> DataFrame:
    points = _on_axes(df, y, ylim)
    tie = [c for c in df.columns if c not in {"sale_price_hpi", y, "count", *by}]
    return loess_by(points, "sale_price_hpi", y, "count", by, span=span, tie=[y, "count", *tie])


def county_curves(study: Study) -> DataFrame:
    by = ["reporting_group", "assessor_term"]
    return _curve(study.ratio_profile_county(), "av_ratio_mailed", RATIO_RANGE, by, 0.75)


def county_total_curves(study: Study) -> DataFrame:
    return _curve(study.ratio_profile_county(), "av_ratio_mailed", RATIO_RANGE, ["assessor_term"], 0.75)


def triad_slice(study: Study, triad: str) -> DataFrame:
    """One triad's profile in its own compared years."""
    label = labels.TRIAD_COMPARISON[triad]
    return study.ratio_profile_triad().where((F.col("triad_name") == triad) & (F.col("comparison_years") == label))


def triad_curves(study: Study, triad: str) -> DataFrame:
    by = ["reporting_group", "assessor_term_year"]
    return _curve(triad_slice(study, triad), "av_ratio_mailed", RATIO_RANGE, by, 0.75)


def board_slice(study: Study, measure: str = "assessed_value_board_mailed_diff") -> DataFrame:
    return study.board_pre_post().where(F.col("name") == measure)


def board_curves(study: Study, measure: str = "assessed_value_board_mailed_diff") -> DataFrame:
    ylim = REDUCTION_PCT_RANGE if measure.endswith("_pct") else REDUCTION_RANGE
    points = board_slice(study, measure).drop("name", "name_label")
    return _curve(points, "value", ylim, ["year"], 1.0)


def appeal_bands(rates: DataFrame, class_type: str, by: list[str]) -> DataFrame:
    """Stacked shares of appealed properties by outcome, increases left out."""
    part = rates.where((F.col("major_class_type") == class_type) & (F.col("result") != "Increase"))
    return stack(part.select(*by, "year", "result", "ratio"), "year", "ratio", "result", by)


def share_labels(inputs, class_type: str) -> DataFrame:
    part = rolls.tax_base_share(inputs).where(F.col("major_class_type") == class_type)
    return part.withColumn("label", percent_label(F.col("value")))


def amount_labels(inputs, class_type: str) -> DataFrame:
    part = rolls.tax_base_absolute(inputs).where(F.col("major_class_type") == class_type)
    return part.withColumn("label", billions_label(F.col("value")))


def judged(study: Study) -> DataFrame:
    """COD, PRD and PRB per year, each with its place against the target range."""
    cod = study.cod_by_year().select("year", F.lit("cod").alias("statistic"), F.col("cod").alias("value"))
    prd = study.prd_by_year().select("year", F.lit("prd").alias("statistic"), F.col("prd").alias("value"))
    prb = study.prb_by_year().select("year", F.lit("prb").alias("statistic"), F.col("est").alias("value"))
    return cod.transform(classify, "value", *TARGETS["cod"]).unionByName(
        prd.transform(classify, "value", *TARGETS["prd"])
    ).unionByName(prb.transform(classify, "value", *TARGETS["prb"]))


def map_slice(areas: DataFrame, term: str, triad: str) -> DataFrame:
    """One map: an assessor's areas of a triad with the ratio squeezed into the colour range."""
    part = areas.where((F.col("assessor_term") == term) & (F.col("triad_name") == triad))
    return part.withColumn("fill", squish(F.col("av_ratio_mailed"), *MAP_RANGE))


def write_feeds(study: Study, cell: float, out_dir: str) -> dict[str, str]:
    """Every chart's table as a parquet feed; returns the paths by name."""
    inputs = study.inputs
    study.keep()
    feeds = {
        "price_index": study.price_index_trend(),
        "county_profile": study.ratio_profile_county(),
        "county_curves": county_curves(study),
        "county_total_curves": county_total_curves(study),
        "board_pre_post": study.board_pre_post(),
        "board_curves": board_curves(study),
        "board_curves_pct": board_curves(study, "assessed_value_board_mailed_diff_pct"),
        "reassessment_calendar": reassessment_calendar(inputs.sales.sparkSession),
        "cod": study.cod_by_year(),
        "prd": study.prd_by_year(),
        "prb": study.prb_by_year(),
        "judged": judged(study),
    }
    rates = stage(rolls.appeal_rates(inputs), "rates").df
    rates_triad = stage(rolls.appeal_rates_triad(inputs), "rates_triad").df
    for kind in ("Residential", "Commercial"):
        feeds[f"share_{kind.lower()}"] = share_labels(inputs, kind)
        feeds[f"amount_{kind.lower()}"] = amount_labels(inputs, kind)
        feeds[f"appeals_{kind.lower()}"] = appeal_bands(rates, kind, [])
        feeds[f"appeals_triad_{kind.lower()}"] = appeal_bands(rates_triad, kind, ["triad_name"])
    ratios = stage(areas.area_ratios(study, cell), "area_ratios").df
    known = areas.area_plurality(inputs).where(F.col("plurality_race").isNotNull())
    for triad in labels.TRIAD_COMPARISON:
        feeds[f"profile_{triad.lower()}"] = triad_slice(study, triad)
        feeds[f"curves_{triad.lower()}"] = triad_curves(study, triad)
        feeds[f"plurality_{triad.lower()}"] = known.join(ratios.where(F.col("triad_name") == triad), "geoid", "left_semi")
        for term in ("Berrios", "Kaegi"):
            feeds[f"map_{triad.lower()}_{term.lower()}"] = map_slice(ratios, term, triad)
    return {name: write_feed(df, name, out_dir) for name, df in feeds.items()}

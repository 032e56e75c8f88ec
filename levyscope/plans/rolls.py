"""Pipelines on the assessment roll and the appeals file: counts, appeal rates, tax base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.functions.scalars import class_code, ieee_div
from levyscope.operators.shape import lower_names, ordered_category, relabel, unpivot_long
from levyscope.operators.shares import share_of_total, sum_by
from levyscope.plans.inputs import Inputs
from levyscope.plans.labels import TAX_BASE_LEVELS, TAX_BASE_MEASURES
from levyscope.scale import join_null_safe

FIRST_YEAR, LAST_YEAR = 2006, 2022
TAX_BASE = ["av_mailed", "av_board", "av_certified", "av_clerk", "tax_bill_total"]


def labelled_classes(inputs: Inputs) -> DataFrame:
    """Class dictionary with the residential label."""
    label = F.when(F.col("major_class_type") == "Residential", F.lit("Residential")).otherwise(F.lit("Non-residential"))
    return inputs.class_dict.withColumn("res_nonres_label", label)


def with_class(df: DataFrame, classes: DataFrame, key: str = "class") -> DataFrame:
    """Inner join to the dictionary; unknown classes drop out. Catalyst broadcasts the dictionary by its own size check."""
    return df.join(classes, df[key] == classes["class_code"], "inner").drop("class_code")


def with_triad(df: DataFrame, townships: DataFrame) -> DataFrame:
    """Triad of a township; rows of an unknown township keep a missing triad."""
    return df.join(townships.select("township_code", "triad_name"), "township_code", "left")


def roll(inputs: Inputs, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    return inputs.assessments.where(F.col("year").between(first, last))


def township_of(df: DataFrame) -> DataFrame:
    return df.withColumn("township_code", F.substring("tax_code_num", 1, 2))


def class_year_summary(inputs: Inputs) -> DataFrame:
    known = with_class(roll(inputs), labelled_classes(inputs)).withColumn("pin_total_count", F.lit(1))
    return sum_by(known, ["year", "major_class_type"], ["pin_total_count", "av_board"])


def class_year_triad_summary(inputs: Inputs) -> DataFrame:
    known = with_class(roll(inputs), labelled_classes(inputs))
    known = with_triad(township_of(known), inputs.townships).withColumn("pin_total_count", F.lit(1))
    return sum_by(known, ["year", "major_class_type", "triad_name"], ["pin_total_count", "av_board"])


def appeals_base(inputs: Inputs) -> DataFrame:
    appeals = lower_names(inputs.appeals).where((F.col("tax_year") >= FIRST_YEAR) & (F.col("class") != 0))
    appeals = appeals.withColumn("class_char", class_code(F.col("class")))
    return (
        with_class(appeals, labelled_classes(inputs), "class_char")
        .withColumn("count", F.lit(1))
        .withColumnsRenamed({"assessor_totalvalue": "assessor_total", "bor_totalvalue": "bor_total"})
    )


def bad_appeal_classes(inputs: Inputs) -> DataFrame:
    """Appeals whose class has four digits: should always be empty."""
    appeals = lower_names(inputs.appeals).where((F.col("tax_year") >= FIRST_YEAR) & (F.col("class") != 0))
    return appeals.where(F.col("class").between(1000, 9999))


APPEAL_SUMS = ["count", "assessor_total", "bor_total"]


def _rates(properties: DataFrame, appeals: DataFrame, keys: list[str]) -> DataFrame:
    appeals = appeals.withColumnRenamed("tax_year", "year")
    both = join_null_safe(properties, appeals, keys, "left")
    return both.withColumn("ratio", ieee_div(F.col("count"), F.col("pin_total_count")))


def appeal_rates(inputs: Inputs) -> DataFrame:
    sums = sum_by(appeals_base(inputs), ["tax_year", "major_class_type", "result"], APPEAL_SUMS)
    return _rates(class_year_summary(inputs), sums, ["year", "major_class_type"])


def appeal_rates_triad(inputs: Inputs) -> DataFrame:
    located = appeals_base(inputs).withColumn("township_code", F.col("township_code").cast("string"))
    located = with_triad(located, inputs.townships)
    sums = sum_by(located, ["tax_year", "major_class_type", "result", "triad_name"], APPEAL_SUMS)
    return _rates(class_year_triad_summary(inputs), sums, ["year", "major_class_type", "triad_name"])


def tax_base(inputs: Inputs) -> DataFrame:
    known = with_class(roll(inputs, 2011), labelled_classes(inputs))
    return sum_by(known, ["major_class_type", "year"], TAX_BASE)


def _long_measures(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Measures as rows under their labels, three of them kept in display order."""
    labels = {f"{name}{suffix}": text for name, text in TAX_BASE_MEASURES.items()}
    tall = unpivot_long(df.select("major_class_type", "year", *cols), ["major_class_type", "year"], cols)
    tall = tall.withColumn("name", relabel(F.col("name"), labels)).where(F.col("name").isin(TAX_BASE_LEVELS))
    return ordered_category(tall, "name", TAX_BASE_LEVELS)


def tax_base_absolute(inputs: Inputs) -> DataFrame:
    return _long_measures(tax_base(inputs), TAX_BASE)


def tax_base_share(inputs: Inputs) -> DataFrame:
    base = tax_base(inputs)  # one row per class and year, in one window pass
    shares = share_of_total(base, TAX_BASE, ["year"], summary=True)
    return _long_measures(shares, [f"{c}_share" for c in TAX_BASE], "_share")

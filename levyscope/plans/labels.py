"""Fixed texts and year groups of the study, and the CASE expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Assessor, first year, last year
TERMS = [("Houlihan", 1998, 2010), ("Berrios", 2011, 2018), ("Kaegi", 2019, 2024)]

# Label of the compared reassessment years, years
COMPARISON = {"2018 vs. 2021": [2018, 2021], "2017 vs. 2020": [2017, 2020], "2016 vs. 2022": [2016, 2022]}
COMPARISON_2 = {
    "2022": [2022],
    "2018 vs. 2021": [2018, 2021],
    "2017 vs. 2020": [2017, 2020],
    "2016 vs. 2019": [2016, 2019],
}
COMPARISON_3 = {"2019 vs. 2022": [2019, 2022], "2018 vs. 2021": [2018, 2021], "2017 vs. 2020": [2017, 2020]}

# Triad, label of its own compared years
TRIAD_COMPARISON = {"City": "2018 vs. 2021", "North": "2016 vs. 2022", "South": "2017 vs. 2020"}

# Reporting groups in display order
REPORTING_GROUPS = ["Single-Family", "Multi-Family", "Condominium"]

# Quartile labels, top first for display
QUARTILES = {1: "Bottom quartile", 2: "Lower middle quartile", 3: "Upper middle quartile", 4: "Top quartile"}
QUARTILE_LEVELS = ["Top quartile", "Upper middle quartile", "Lower middle quartile", "Bottom quartile"]

# Measure labels
BOARD_MEASURES = {
    "count": "Count",
    "av_mailed_hpi": "Assessed value (mailed), HPI",
    "av_board_hpi": "Assessed value (Board of Review), HPI",
    "av_ratio_mailed": "Assessed value ratio (mailed)",
    "av_ratio_board": "Assessed value ratio (Board of Review)",
    "sale_price_hpi": "Sale price, HPI",
    "assessed_value_board_mailed_ratio": "Board of Review assessment relative to mailed assessment",
    "assessed_value_board_mailed_diff": "Reduction in assessed value after Board of Review appeal",
    "assessed_value_board_mailed_diff_pct": "Percent change in assessed value after Board of Review appeal",
}
TAX_BASE_MEASURES = {
    "tax_bill_total": "Tax bills",
    "av_board": "Assessed value (Board of Review)",
    "av_certified": "Assessed value (certified)",
    "av_clerk": "Assessed value (Clerk)",
    "av_mailed": "Assessed value (mailed)",
}
TAX_BASE_LEVELS = ["Assessed value (mailed)", "Assessed value (Board of Review)", "Tax bills"]

# Census variable, population group
RACES = {
    "B03002_012": "Latino/a",
    "B03002_003": "White",
    "B03002_004": "Black",
    "B03002_005": "Native American",
    "B03002_006": "Asian/Pacific Islander",
    "B03002_007": "Asian/Pacific Islander",
    "B03002_008": "Multiracial/Other",
    "B03002_009": "Multiracial/Other",
}
RACE_NAMES = ["Latino/a", "White", "Black", "Native American", "Asian/Pacific Islander", "Multiracial/Other"]


def year_label(year: Column, groups: dict[str, list[int]], default: str) -> Column:
    out = None
    for label, years in groups.items():
        hit = year.isin(years)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def assessor_term(year: Column) -> Column:
    """Assessor in office; NULL outside the listed terms."""
    return F.coalesce(*[F.when(year.between(first, last), F.lit(name)) for name, first, last in TERMS])


def own_comparison(triad: Column, comparison: Column) -> Column:
    """The triad's rows in its own compared years."""
    hit = F.lit(False)
    for name, label in TRIAD_COMPARISON.items():
        hit = hit | ((triad == name) & (comparison == label))
    return hit

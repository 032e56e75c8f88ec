"""Entries of the named pipelines Q1-Q26."""

from __future__ import annotations

import functools
import math

from levyscope.operators.outliers import TRIMS
from levyscope.plans import areas, rolls, study
from levyscope.registry.entries import entry
from levyscope.registry.fixtures import CELL

entry("Q1_latest_sales", "SELECT pin, year, sale_date, sale_price, sale_key FROM latest", "sale_price:4")(
    lambda c: study.latest_sales(c.inputs).drop("sale_date_posix")
)
entry("Q2_class_year_summary", "SELECT * FROM class_year", "av_board:2")(lambda c: rolls.class_year_summary(c.inputs))
entry("Q3_class_year_triad_summary", "SELECT * FROM class_year_triad", "av_board:2")(
    lambda c: rolls.class_year_triad_summary(c.inputs)
)
entry("Q4_appeals_base", 'SELECT *, 1 AS "count" FROM appeal_base', "class:2 assessor_total:4 bor_total:4")(
    lambda c: rolls.appeals_base(c.inputs)
)
RATES = 'av_board:2 assessor_total:2 bor_total:2 ratio:7'
entry("Q5_appeal_rates", "SELECT * FROM rates", RATES)(lambda c: rolls.appeal_rates(c.inputs))
entry("Q6_appeal_rates_triad", "SELECT * FROM rates_triad", RATES)(lambda c: rolls.appeal_rates_triad(c.inputs))

MONEY = "tax_bill_total:4 av_mailed:4 av_certified:4 av_board:4 av_clerk:4"
RATIOS = "av_ratio_mailed:7 av_ratio_certified:7 av_ratio_board:7 av_ratio_clerk:7"
BASE = """pin, year, township_code, tax_code_num, class, tax_bill_total, av_mailed, av_certified, av_board, av_clerk,
  reporting_group, triad_name, sale_price, sale_key, av_ratio_mailed, av_ratio_certified, av_ratio_board, av_ratio_clerk"""
entry("Q7_sales_ratio_base", f"SELECT {BASE} FROM base", f"{MONEY} {RATIOS}")(
    lambda c: study.sales_ratio_base(c.inputs).drop("sale_date", "sale_date_posix")
)
FLAGS = """outlier_flag_iaao, av_ratio_1_to_99, av_ratio_2_to_98, av_ratio_3_to_97, av_ratio_4_to_96, av_ratio_5_to_95"""
entry("Q8_outlier_flags", f"SELECT pin, year, av_ratio_mailed, {FLAGS} FROM flagged", "av_ratio_mailed:7")(
    lambda c: c.study.flagged().select("pin", "year", "av_ratio_mailed", *[f.strip() for f in FLAGS.split(",")])
)
VALUES = ("tax_bill_total", "sale_price", "av_mailed", "av_certified", "av_board", "av_clerk")
ADJUSTED = [f"{v}_{s}" for s in ("case_shiller", "hpi") for v in VALUES]
ADJ_PLACES = " ".join(f"{a}:4" for a in ADJUSTED)
entry(
    "Q9_adjusted_sales",
    f"SELECT pin, year, case_shiller, hpi, {', '.join(ADJUSTED)}, effective_tax_rate FROM adjusted",
    f"{ADJ_PLACES} effective_tax_rate:7",
)(lambda c: c.study.adjusted().select("pin", "year", "case_shiller", "hpi", *ADJUSTED, "effective_tax_rate"))
GROUPS = [
    "reporting_group", "reporting_group_ord", "assessor_term", "comparison_years", "comparison_years2",
    "comparison_years3", "assessor_term_year",
]
entry("Q10_comparison_groups", f"SELECT pin, year, {', '.join(GROUPS)} FROM grouped")(
    lambda c: c.study.grouped().select("pin", "year", *GROUPS)
)
entry(
    "Q11_clean_universe",
    f"SELECT {BASE}, {FLAGS}, {', '.join(ADJUSTED)}, effective_tax_rate, {', '.join(GROUPS[1:])}, zscore FROM clean",
    f"{MONEY} {RATIOS} {ADJ_PLACES} effective_tax_rate:7 zscore:6",
)(lambda c: c.study.clean(TRIMS).drop("sale_date", "sale_date_posix", "case_shiller", "hpi"))
entry(
    "Q12_price_index_trend",
    """
    WITH q AS (
      SELECT sales_ntile, year, count(*) AS "count", sum(sale_price_hpi) AS sale_price_hpi_sum, avg(sale_price_hpi) AS sale_price_hpi_avg
      FROM (SELECT *, CAST(ntile(4) OVER (PARTITION BY year, reporting_group ORDER BY sale_price_hpi, pin) AS INTEGER) AS sales_ntile FROM clean)
      GROUP BY sales_ntile, year)
    SELECT q.*, b.sale_price_hpi_avg AS sale_price_hpi_avg_2016, q.sale_price_hpi_avg / b.sale_price_hpi_avg AS sales_index,
      CASE q.sales_ntile WHEN 1 THEN 'Bottom quartile' WHEN 2 THEN 'Lower middle quartile' WHEN 3 THEN 'Upper middle quartile'
        WHEN 4 THEN 'Top quartile' END AS sales_index_label,
      CAST(5 - q.sales_ntile AS INTEGER) AS sales_index_label_ord
    FROM q LEFT JOIN q b ON q.sales_ntile = b.sales_ntile AND b.year = 2016""",
    "sale_price_hpi_sum:2 sale_price_hpi_avg:3 sale_price_hpi_avg_2016:3 sales_index:7",
)(lambda c: c.study.price_index_trend())
PROFILE = "av_ratio_mailed:7 sale_price:4 sale_price_hpi:4"
entry("Q13_ratio_profile_county", "SELECT * FROM profile_county", PROFILE)(lambda c: c.study.ratio_profile_county())
entry("Q14_ratio_profile_triad", "SELECT * FROM profile_triad", PROFILE)(lambda c: c.study.ratio_profile_triad())
# Display texts of the measures
BOARD_LABEL = """CASE name
  WHEN 'av_mailed_hpi' THEN 'Assessed value (mailed), HPI' WHEN 'av_board_hpi' THEN 'Assessed value (Board of Review), HPI'
  WHEN 'av_ratio_mailed' THEN 'Assessed value ratio (mailed)' WHEN 'av_ratio_board' THEN 'Assessed value ratio (Board of Review)'
  WHEN 'assessed_value_board_mailed_ratio' THEN 'Board of Review assessment relative to mailed assessment'
  WHEN 'assessed_value_board_mailed_diff' THEN 'Reduction in assessed value after Board of Review appeal'
  WHEN 'assessed_value_board_mailed_diff_pct' THEN 'Percent change in assessed value after Board of Review appeal' END"""
entry(
    "Q15_board_pre_post",
    f"SELECT *, {BOARD_LABEL} AS name_label FROM board_long",
    "sale_price:4 sale_price_hpi:4 value:4",
)(lambda c: c.study.board_pre_post())
entry("Q16_tax_base_absolute", "SELECT * FROM tax_long", "value:2")(lambda c: rolls.tax_base_absolute(c.inputs))
entry("Q17_tax_base_share", "SELECT * FROM share_long", "value:7")(lambda c: rolls.tax_base_share(c.inputs))
entry("Q18_cod_by_year", "SELECT * FROM cod", "cod:7")(lambda c: c.study.cod_by_year())
PRD = "mean_av:7 median_av:7 weighted_mean_av:7 prd:7"
entry("Q19_prd_by_year", "SELECT * FROM prd", PRD)(lambda c: c.study.prd_by_year())



def t995(most: int = 300) -> list[float]:
    """Student t quantiles at .995 for 1 to ``most`` degrees of freedom, from the finite sums of the distribution function for
    whole degrees of freedom (in sines and cosines of atan(t / sqrt(d))), halved down to the last bit."""

    def within(t: float, d: int) -> float:
        arc = math.atan(t / math.sqrt(d))
        cos2 = math.cos(arc) ** 2
        term = total = math.cos(arc) if d % 2 else 1.0
        for k in range(2 + d % 2, d - 1, 2):
            term *= cos2 * (k - 1) / k
            total += term
        if d == 1:
            return 2 * arc / math.pi
        return 2 / math.pi * (arc + math.sin(arc) * total) if d % 2 else math.sin(arc) * total

    out, high = [], 64.0
    for d in range(1, most + 1):
        low, top = 2.5, high
        while low < (mid := (low + top) / 2) < top:
            low, top = (mid, top) if within(mid, d) < 0.99 else (low, mid)
        out.append(low)
        high = low + 1e-9
    return out


@functools.cache
def t995_sql() -> str:
    """The list, and beyond its end the normal quantile with terms up to d^-3, which there errs by less than 1e-9."""
    return f"""CASE WHEN d <= 300 THEN [{", ".join(f"{t!r}::DOUBLE" for t in t995())}][CAST(d AS BIGINT)]
      ELSE 2.5758293035489004::DOUBLE + (pow(z, 3) + z) / 4 / d + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / (d * d)
        + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / (d * d * d) END"""


INTERVAL = "intercept:6 est:6 lower:6 upper:6"


def interval_sql(fit: str, keys: str, pooled: bool) -> str:
    over = "OVER ()" if pooled else f"OVER (PARTITION BY {keys})"
    return f"""
    SELECT {keys}, intercept, est, est - t * sqrt(s / d / sxx) AS lower, est + t * sqrt(s / d / sxx) AS upper, n
    FROM (SELECT *, {t995_sql()} AS t FROM
      (SELECT *, sum(rss) {over} AS s, CAST(sum(n - 2) {over} AS DOUBLE) AS d, 2.5758293035489004::DOUBLE AS z FROM {fit}))"""


entry("Q20_prb_by_year", interval_sql("prb_fit", "year", True), INTERVAL)(lambda c: c.study.prb_by_year())
entry("Q21_race_by_area", "SELECT * FROM race")(lambda c: areas.race_by_area(c.inputs))
# Census groups and their column names
RACE_COLUMNS = {
    "Latino/a": "latino_a", "White": "white", "Black": "black", "Native American": "native_american",
    "Asian/Pacific Islander": "asian_pacific_islander", "Multiracial/Other": "multiracial_other",
}
entry(
    "Q22_race_wide",
    "SELECT geoid, summary_est, "
    + ", ".join(
        f"max(CASE WHEN race = '{r}' THEN {e} END) AS {p}_{n}"
        for p, e in (("shr", "estimate / summary_est"), ("estimate", "estimate"))
        for r, n in RACE_COLUMNS.items()
    )
    + " FROM race GROUP BY geoid, summary_est",
    " ".join(f"shr_{n}:7" for n in RACE_COLUMNS.values()),
)(lambda c: areas.race_wide(c.inputs))
entry("Q23_race_plurality", "SELECT * FROM plurality", "plurality_race_share:7")(lambda c: areas.race_plurality(c.inputs))
entry("Q24_pin_to_area", "SELECT pin10, geoid FROM pin_area")(lambda c: areas.parcel_areas(c.inputs, CELL))
AREA = " ".join(f"{v}_hpi:2" for v in VALUES) + " av_ratio_mailed:7 av_ratio_board:7 av_board_mailed_diff:2 plurality_race_share:7"
entry("Q25_area_ratios", "SELECT * FROM area_ratios", AREA)(lambda c: areas.area_ratios(c.study, CELL).drop("ring"))
entry(
    "Q26_area_plurality_map",
    """SELECT DISTINCT triad_name, geoid, median_income, plurality_race, plurality_race_population, plurality_race_share
       FROM area_ratios WHERE triad_name IS NOT NULL AND plurality_race IS NOT NULL""",
    "plurality_race_share:7",
)(lambda c: areas.area_plurality_map(c.study, CELL).drop("ring"))

"""Sales-ratio study: from sales and assessments to the fairness statistics."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyscope.functions.scalars import ieee_div, month_date, pad_left, paste, strict_mean, strict_sum
from levyscope.operators import ratios
from levyscope.operators.outliers import NO_TRIMS, TRIMS, ratio_flags, zscore_by_group
from levyscope.operators.rank import latest_per_key, ntile
from levyscope.operators.shape import adjust, ordered_category, relabel, unpivot_long
from levyscope.plans import labels
from levyscope.plans.inputs import Inputs
from levyscope.plans.rolls import FIRST_YEAR, roll, township_of, with_class, with_triad
from levyscope.scale import Staged, is_small, settle, stage

PIN_WIDTH = 14
VALUES = ["tax_bill_total", "sale_price", "av_mailed", "av_certified", "av_board", "av_clerk"]
STAGES = ["mailed", "certified", "board", "clerk"]
FENCE_GROUP = ["year", "township_code", "class"]
PROFILE = (
    "pin", "year", "triad_name", "reporting_group", "comparison_years", "assessor_term", "assessor_term_year", "av_ratio_mailed",
    "sale_price", "sale_price_hpi",
)
MAX_Z = 3
MIN_VALUE = 100


def latest_sales(inputs: Inputs) -> DataFrame:
    """The last sale of each (pin, year) with a readable date."""
    sales = inputs.sales.where(F.col("year") >= FIRST_YEAR).drop("class", "township_code")
    sales = sales.withColumn("pin", pad_left(F.col("pin"), PIN_WIDTH))
    sales = sales.withColumn("sale_date_posix", month_date(F.col("sale_date")))
    return latest_per_key(sales, ["pin", "year"], "sale_date_posix", "sale_key")


def regression_classes(inputs: Inputs) -> DataFrame:
    return inputs.class_dict.where("regression_class").select("reporting_group", "class_code")


def sales_ratio_base(inputs: Inputs) -> DataFrame:
    """Assessments of regression classes with the sale of the same pin and year, and the four ratios."""
    parcels = township_of(with_class(roll(inputs), regression_classes(inputs)))
    parcels = with_triad(parcels, inputs.townships).withColumn("pin", pad_left(F.col("pin"), PIN_WIDTH))
    sold = parcels.join(settle(latest_sales(inputs), "latest_sales"), ["pin", "year"], "inner")
    return sold.withColumns(
        {f"av_ratio_{s}": ieee_div(F.col(f"av_{s}"), F.col("sale_price")) for s in STAGES}
    )


def planned_once(method):
    """Keep a step's plan on its study, so that steps built on it do not rank the same sales again."""
    name = f"_planned_{method.__name__}"

    @functools.wraps(method)
    def call(self):
        if name not in self.__dict__:
            self.__dict__[name] = method(self)
        return self.__dict__[name]

    return call


class Study:
    """The chain of shared steps. ``base`` is written once; every later step is a lazy plan over that table."""

    def __init__(self, inputs: Inputs, base_year: int = 2006):
        self.inputs = inputs
        self.base_year = base_year
        self._plans: dict[tuple, DataFrame] = {}
        self._clean: dict[tuple, DataFrame] = {}

    @functools.cached_property
    def base(self) -> Staged:
        return stage(sales_ratio_base(self.inputs), "base")

    @property
    def rows(self) -> int:
        """Measured rows of the base; every later step has at most as many."""
        return self.base.rows

    # The trim flags are part of the outlier table but no statistic reads them, so later steps leave them out by default.

    def flagged(self, trims: list[float] = TRIMS) -> DataFrame:
        """Fence flag and trim flags of the mailed ratio within (year, township, class)."""
        return ratio_flags(self.base.df, "av_ratio_mailed", FENCE_GROUP, self.rows, trims=trims)

    def adjusted(self, trims: list[float] = NO_TRIMS) -> DataFrame:
        """Values in constant prices under both indices, and the effective tax rate."""
        priced = self.flagged(trims).join(self.inputs.prices, "year", "left")
        priced = adjust(priced, VALUES, ["case_shiller", "hpi"])
        return priced.withColumn("effective_tax_rate", ieee_div(F.col("tax_bill_total"), F.col("sale_price")))

    def grouped(self, trims: list[float] = NO_TRIMS) -> DataFrame:
        """Assessor term, compared years and reporting group; the lodging class is out."""
        year = F.col("year")
        named = self.adjusted(trims).where(F.col("reporting_group") != "Bed & Breakfast")
        named = named.withColumns(
            {
                "assessor_term": labels.assessor_term(year),
                "comparison_years2": labels.year_label(year, labels.COMPARISON_2, "Before 2015"),
                "comparison_years3": labels.year_label(year, labels.COMPARISON_3, "Before 2016"),
                "comparison_years": labels.year_label(year, labels.COMPARISON, "Before 2015"),
            }
        )
        named = named.withColumn("assessor_term_year", paste(F.col("assessor_term"), year))
        return ordered_category(named, "reporting_group", labels.REPORTING_GROUPS)

    def scored(self, trims: list[float] = NO_TRIMS) -> DataFrame:
        """z-score of the adjusted price within the reporting group, over all years."""
        return zscore_by_group(self.grouped(trims), "sale_price_hpi", ["reporting_group"], rows=self.rows)

    def clean(self, trims: list[float] = NO_TRIMS, columns: tuple[str, ...] | None = None) -> DataFrame:
        """The sales all statistics use. Planned once per study: group statistics may have been written on the way. If they are
        many they are written once, as medians, tilings and trends read them several times; a statistic names its ``columns``, and
        only these are written for it, unless the whole rows have been (``keep``)."""
        key = tuple(trims)
        if (key, None) in self._clean:
            whole = self._clean[key, None]
            return whole if columns is None else whole.select(*columns)
        if (key, columns) not in self._clean:
            if key not in self._plans:
                self._plans[key] = self._clean_plan(trims)
            plan = self._plans[key] if columns is None else self._plans[key].select(*columns)
            self._clean[key, columns] = plan if is_small(self.rows) else stage(plan, "clean").df
        return self._clean[key, columns]

    def keep(self) -> Study:
        """Write the clean sales once, for callers that build many tables from one study."""
        self._clean[(), None] = stage(self.clean(), "clean").df
        return self

    def _clean_plan(self, trims: list[float]) -> DataFrame:
        inside = (F.col("outlier_flag_iaao") == 1) & (F.col("zscore") < MAX_Z) & (F.col("year") >= FIRST_YEAR)
        worth = (F.col("av_mailed") > MIN_VALUE) & (F.col("sale_price") > MIN_VALUE)
        return self.scored(trims).where(inside & worth)

    # -- statistics by year

    def cod_by_year(self) -> DataFrame:
        return ratios.cod(self.clean(columns=("year", "av_ratio_mailed")), "av_ratio_mailed", ["year"], self.rows)

    def prd_by_year(self) -> DataFrame:
        sales = self.clean(columns=("year", "av_ratio_mailed", "sale_price_hpi"))
        return ratios.prd(sales, "av_ratio_mailed", "sale_price_hpi", ["year"], self.rows)

    def prb_terms(self) -> DataFrame:
        sales = self.clean(columns=("year", "av_ratio_mailed", "av_mailed", "sale_price"))
        return ratios.prb_terms(sales, "av_ratio_mailed", "av_mailed", "sale_price", ["year"], self.rows)

    def prb_by_year(self, level: float = 0.99, pool: bool = True) -> DataFrame:
        return ratios.ols_interval(self.prb_terms(), "prb_pct_diff", "prb_ln_value", ["year"], level, pool)

    # -- price index and percentile profiles

    def tiled(self, df: DataFrame, k: int, by: list[str]) -> DataFrame:
        return ntile(df, "sales_ntile", k, by, "sale_price_hpi", "pin", self.rows)

    def price_index_trend(self) -> DataFrame:
        """Average adjusted price per (quartile, year) relative to the base year."""
        sales = self.clean(columns=("pin", "year", "reporting_group", "sale_price_hpi"))
        quartiles = self.tiled(sales, 4, ["year", "reporting_group"])
        price = F.col("sale_price_hpi")
        trend = quartiles.groupBy("sales_ntile", "year").agg(
            F.count(F.lit(1)).alias("count"),
            strict_sum(price).alias("sale_price_hpi_sum"),
            strict_mean(price).alias("sale_price_hpi_avg"),
        )
        trend = index_to_base(trend, "sales_ntile", "year", "sale_price_hpi_avg", self.base_year, "sales_index")
        trend = trend.withColumn("sales_index_label", relabel(F.col("sales_ntile"), labels.QUARTILES))
        return ordered_category(trend, "sales_index_label", labels.QUARTILE_LEVELS)

    def _profile(self, df: DataFrame, tile_by: list[str], keys: list[str]) -> DataFrame:
        tiles = self.tiled(df, 100, tile_by)
        return ratios.mean_by(tiles, ["sales_ntile", *keys], ["av_ratio_mailed", "sale_price", "sale_price_hpi"])

    @planned_once
    def ratio_profile_county(self) -> DataFrame:
        """Ratio against price by percentile, each triad in its own compared years."""
        own = labels.own_comparison(F.col("triad_name"), F.col("comparison_years"))
        sales = self.clean(columns=PROFILE).where((F.col("year") >= 2016) & own)
        keys = ["reporting_group", "comparison_years", "assessor_term", "assessor_term_year"]
        return self._profile(sales, ["year", "reporting_group"], keys)

    @planned_once
    def ratio_profile_triad(self) -> DataFrame:
        sales = self.clean(columns=PROFILE).where(F.col("year") >= 2016)
        keys = ["reporting_group", "triad_name", "comparison_years", "assessor_term", "assessor_term_year"]
        return self._profile(sales, ["year", "triad_name", "reporting_group"], keys)

    @planned_once
    def board_summary(self) -> DataFrame:
        """Mailed and board values by price percentile and year, with their ratio and difference."""
        means = ["av_mailed_hpi", "av_board_hpi", "av_ratio_mailed", "av_ratio_board", "sale_price", "sale_price_hpi"]
        sales = self.clean(columns=("pin", "year", "assessor_term", *means)).where(F.col("year") >= 2019)
        tiles = self.tiled(sales, 100, ["year"])
        wide = ratios.mean_by(tiles, ["year", "sales_ntile", "assessor_term"], means)
        mailed, board = F.col("av_mailed_hpi"), F.col("av_board_hpi")
        return wide.withColumns(
            {
                "assessed_value_board_mailed_ratio": ieee_div(board, mailed),
                "assessed_value_board_mailed_diff": board - mailed,
                "assessed_value_board_mailed_diff_pct": ieee_div(board - mailed, mailed),
            }
        )

    def board_pre_post(self) -> DataFrame:
        ids = ["year", "sales_ntile", "assessor_term", "count", "sale_price", "sale_price_hpi"]
        wide = self.board_summary()
        tall = unpivot_long(wide, ids, [c for c in wide.columns if c not in ids])
        return tall.withColumn("name_label", relabel(F.col("name"), labels.BOARD_MEASURES))


def index_to_base(df: DataFrame, key: str, year: str, value: str, base_year: int, name: str) -> DataFrame:
    """Value relative to the key's own base-year value.

    Runs on a summary with one row per (key, year): a window group has as many rows as there are years, and the summary
    is read once where a self-join would compute it twice.
    """
    start = F.max(F.when(F.col(year) == base_year, F.col(value))).over(Window.partitionBy(key))
    return df.withColumn(f"{value}_{base_year}", start).withColumn(
        name, ieee_div(F.col(value), F.col(f"{value}_{base_year}"))
    )

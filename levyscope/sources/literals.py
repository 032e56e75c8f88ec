"""Tables the study writes out in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Year, national home price index, expanded-data house price index (2023 = 1)
PRICE_MULTIPLIERS = [
    (2006, 1.663090915, 1.14407178),
    (2007, 1.695792557, 1.174738966),
    (2008, 1.859953584, 1.376691816),
    (2009, 2.054125555, 1.66707653),
    (2010, 2.109306578, 1.797687182),
    (2011, 2.191465155, 1.96643901),
    (2012, 2.164322318, 2.015771149),
    (2013, 1.974783404, 1.87304141),
    (2014, 1.852951133, 1.755724941),
    (2015, 1.772351191, 1.674818614),
    (2016, 1.686676152, 1.572943284),
    (2017, 1.594359191, 1.47916753),
    (2018, 1.507122687, 1.403425097),
    (2019, 1.456873311, 1.354186158),
    (2020, 1.373748227, 1.266441223),
    (2021, 1.173319935, 1.142716924),
    (2022, 1.022240399, 1.027848684),
    (2023, 1.0, 1.0),
]

# Year, consumer price index for housing (2023 = 1)
CPI_MULTIPLIERS = [
    (2013, 1.337313638),
    (2014, 1.311831482),
    (2015, 1.287789597),
    (2016, 1.27184103),
    (2017, 1.240585497),
    (2018, 1.214959196),
    (2019, 1.182246279),
    (2020, 1.153904209),
    (2021, 1.13468867),
    (2022, 1.068232043),
    (2023, 1.0),
]

# Reassessment order, repeating every three years from 2011
TRIAD_CYCLE = ["South", "City", "North"]


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Rows as SQL VALUES: a local relation whose exact size Catalyst knows, so joins broadcast it by themselves."""

    def text(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v)

    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def price_index(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PRICE_MULTIPLIERS, ["year", "case_shiller", "hpi"])


def cpi_index(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CPI_MULTIPLIERS, ["year", "cpi"])


def reassessment_calendar(spark: SparkSession, first: int = 2011, last: int = 2022) -> DataFrame:
    """One row per year with the triad reassessed in it."""
    turn = (F.col("id") % len(TRIAD_CYCLE) + 1).cast("int")
    triads = F.array(*[F.lit(t) for t in TRIAD_CYCLE])
    return spark.range(last - first + 1).select(
        (F.col("id") + first).cast("int").alias("year"), F.element_at(triads, turn).alias("triad_name")
    )

"""The study's input tables derived from the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscope.plans.inputs import Inputs
from levyscope.sources.literals import literal_table, price_index
from levyscope.sources.readers import read_table

YEARS_ADDED = 21
BASE_YEAR = 2016
CELL = 0.18
TILE = 0.02

# Market segment, property class, census variable
SEGMENTS = [
    ("BUILDING", "202", "B03002_012"),
    ("HOUSEHOLD", "203", "B03002_003"),
    ("FURNITURE", "212", "B03002_004"),
    ("AUTOMOBILE", "299", "B03002_006"),
    ("MACHINERY", "218", "B03002_008"),
]

# Class code, reporting group, major class type, regression class
CLASSES = [
    ("202", "Single-Family", "Residential", 1),
    ("203", "Single-Family", "Residential", 1),
    ("212", "Multi-Family", "Residential", 1),
    ("299", "Condominium", "Residential", 1),
    ("218", "Bed & Breakfast", "Residential", 1),
    ("517", "Commercial", "Commercial", 0),
]


# Schemas of the driver tables in use: naming them saves the job that reads them from the files
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def by_segment(position: int):
    out = None
    for row in SEGMENTS:
        hit = F.col("c_mktsegment") == row[0]
        out = F.when(hit, row[position]) if out is None else out.when(hit, row[position])
    return out


def known(text):
    """Text made from keys, never missing: saying so spares Catalyst a null test of the built text on every row."""
    return F.coalesce(text, F.lit(""))


def study_year():
    return (F.year("o_orderdate") + YEARS_ADDED).cast("int")


def sales(spark, sf_dir) -> DataFrame:
    moved = F.add_months(F.col("o_orderdate").cast("date"), 12 * YEARS_ADDED)
    return table(spark, sf_dir, "orders").select(
        known(F.concat(F.col("o_custkey").cast("string"), F.lit("0000"))).alias("pin"),
        study_year().alias("year"),
        F.date_format(moved, "MMMM dd yyyy").alias("sale_date"),
        F.col("o_totalprice").alias("sale_price"),
        F.col("o_orderkey").alias("sale_key"),
        F.lit("0").alias("class"),
        F.lit(0).alias("township_code"),
    )


def assessments(spark, sf_dir) -> DataFrame:
    """Parcels per (customer, year) and commercial parcels per (supplier, year), from one read and one join of the lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", study_year().alias("year"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    owner = F.explode(
        F.array(
            F.struct(F.lit("parcel").alias("kind"), F.col("o_custkey").alias("key")),
            F.struct(F.lit("commercial").alias("kind"), F.col("l_suppkey").alias("key")),
        )
    )
    ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    measures = lines.select(
        owner.alias("owner"), "year", ext.alias("m"), (ext * (1 - disc / 2)).alias("c"), (ext * (1 - disc)).alias("b"),
        (ext * tax).alias("t"),
    )
    sums = measures.groupBy("owner.kind", "owner.key", "year").agg(
        F.sum("m").alias("m"), F.sum("c").alias("c"), F.sum("b").alias("b"), F.sum("t").alias("t")
    )
    people = table(spark, sf_dir, "customer").select(
        F.lit("parcel").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"),
        by_segment(1).alias("class"),
    )
    firms = table(spark, sf_dir, "supplier").select(
        F.lit("commercial").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"),
        F.lit("517").alias("class"),
    )
    key = F.col("key").cast("string")
    pin = F.when(F.col("kind") == "parcel", F.concat(key, F.lit("0000"))).otherwise(
        F.concat(F.lit("9"), F.lpad(key, 13, "0"))
    )
    return sums.join(people.unionByName(firms), ["kind", "key"]).select(
        "year",
        known(pin).alias("pin"),
        F.concat((F.col("nation") + 10).cast("string"), F.lit("001")).alias("tax_code_num"),
        "class",
        F.col("t").alias("tax_bill_total"),
        (F.col("m") * 0.1).alias("av_mailed"),
        (F.col("c") * 0.1).alias("av_certified"),
        (F.col("b") * 0.1).alias("av_board"),
        (F.col("b") * 0.1).alias("av_clerk"),
    )


def class_dict(spark) -> DataFrame:
    rows = literal_table(spark, CLASSES, ["class_code", "reporting_group", "major_class_type", "regression_class"])
    return rows.withColumn("regression_class", F.col("regression_class") == 1)


def townships(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    triad = (
        F.when(F.col("r_name") == "AMERICA", "City").when(F.col("r_name") == "EUROPE", "North")
        .when(F.col("r_name") == "ASIA", "South")
    )
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    code = (F.col("n_nationkey") + 10).cast("string")
    return named.select(code.alias("township_code"), triad.alias("triad_name")).where("triad_name is not null")


def appeals(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", study_year().alias("TAX_YEAR"))
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", by_segment(1).cast("double").alias("code")
    )
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(people, F.col("o_custkey") == F.col("c_custkey"))
    number = F.col("l_linenumber")
    flag = F.col("l_returnflag")
    return lines.select(
        "TAX_YEAR",
        F.when(number == 2, 0.0).when(number == 1, F.col("code") * 100).otherwise(F.col("code")).alias("CLASS"),
        (F.col("c_nationkey") + 10).alias("TOWNSHIP_CODE"),
        F.when(flag == "A", "No Change").when(flag == "R", "Decrease").when(flag == "N", "Increase").alias("RESULT"),
        (F.col("l_extendedprice") * 0.1).alias("ASSESSOR_TOTALVALUE"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * 0.1).alias("BOR_TOTALVALUE"),
    )


def acs_race(spark, sf_dir) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), by_segment(2).alias("variable"))
    firms = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.lit("B03002_007").alias("variable")
    )
    counts = people.unionByName(firms).groupBy("nation", "variable").agg(F.count(F.lit(1)).cast("double").alias("estimate"))
    totals = counts.groupBy("nation").agg(F.sum("estimate").alias("summary_est"))
    return counts.join(totals, "nation").select(
        (F.col("nation") + 100).cast("string").alias("GEOID"), "variable", "estimate", "summary_est"
    )


def pin_points(spark, sf_dir) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("pin10"),
        F.col("embedding")[0].cast("double").alias("longitude"),
        F.col("embedding")[1].cast("double").alias("latitude"),
    )
    again = vec.where("vec_id % 7 = 0").withColumn("longitude", F.col("longitude") + 0.01)
    return vec.unionByName(again).drop("vec_id")


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def block_groups(spark) -> DataFrame:
    col, row = (F.col("id") % 5), F.floor(F.col("id") / 5)

    def edge(i):
        return F.lit(-0.45) + F.lit(0.18) * i

    x0, x1, y0, y1 = edge(col), edge(col + 1), edge(row), edge(row + 1)
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    square = F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1), _point(x0, y0))
    notched = F.array(
        _point(x0, y0), _point(x1, y0), _point(x1, ym), _point(xm, ym), _point(xm, y1), _point(x0, y1), _point(x0, y0)
    )
    return spark.range(25).select(
        (F.col("id") + 100).cast("string").alias("geoid"),
        (F.col("id") + 1100).cast("double").alias("estimate"),
        F.when(F.col("id") == 12, notched).otherwise(square).alias("ring"),
    )


def label_tiles(spark, sf_dir) -> DataFrame:
    """Square tiles that hold at least one vector, with the most frequent label (least on ties) as category."""
    vec = table(spark, sf_dir, "embeddings")
    at = vec.select(
        F.floor(F.col("embedding")[0].cast("double") / TILE).alias("cx"),
        F.floor(F.col("embedding")[1].cast("double") / TILE).alias("cy"),
        "label",
    )
    counts = at.groupBy("cx", "cy", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("cx", "cy").agg(F.max(F.struct("n", -F.col("label"))).alias("best"), F.sum("n").alias("n"))

    def edge(c):
        return c * F.lit(TILE)

    x0, x1, y0, y1 = edge(F.col("cx")), edge(F.col("cx") + 1), edge(F.col("cy")), edge(F.col("cy") + 1)
    name = F.concat(*[F.lpad((F.col(c) + 50000).cast("string"), 6, "0") for c in ("cx", "cy")])
    category = F.pmod(-F.col("best")[F.lit("col2")], F.lit(3)).cast("string")
    return best.select(
        name.alias("geoid"),
        category.alias("category"),
        "n",
        F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1), _point(x0, y0)).alias("ring"),
    )


def varied_areas(spark, sf_dir) -> DataFrame:
    """The tiles as areas of three forms, by their count: a square, one with a square hole, one of two strips; and one area
    a thousand tiles wide around them. Their number grows with the tables."""
    ring = F.col("ring")
    x0, y0, x1, y1 = ring[0]["x"], ring[0]["y"], ring[2]["x"], ring[2]["y"]

    def box(a, b, c, d):
        xa, xb, ya, yb = x0 + (x1 - x0) * a, x0 + (x1 - x0) * b, y0 + (y1 - y0) * c, y0 + (y1 - y0) * d
        return F.array(_point(xa, ya), _point(xb, ya), _point(xb, yb), _point(xa, yb), _point(xa, ya))

    form = F.pmod("n", F.lit(3))
    holed, strips = F.array(ring, box(0.25, 0.75, 0.25, 0.75)), F.array(box(0, 1 / 3, 0, 1), box(2 / 3, 1, 0, 1))
    rings = F.when(form == 0, F.array(ring)).when(form == 1, holed).otherwise(strips)
    far = spark.range(1).select(F.lit("around").alias("geoid"), F.lit(10.0).alias("r"))
    corners = [_point(F.col("r") * i, F.col("r") * j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    around = far.select("geoid", F.array(F.array(*corners)).alias("rings"))
    return label_tiles(spark, sf_dir).select("geoid", rings.alias("rings")).unionByName(around)


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(
        sales=lambda: sales(spark, sf_dir),
        assessments=lambda: assessments(spark, sf_dir),
        class_dict=lambda: class_dict(spark),
        townships=lambda: townships(spark, sf_dir),
        appeals=lambda: appeals(spark, sf_dir),
        prices=lambda: price_index(spark),
        acs_race=lambda: acs_race(spark, sf_dir),
        block_groups=lambda: block_groups(spark),
        pin_points=lambda: pin_points(spark, sf_dir),
    )

"""Connected groups of a graph, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.scale import Staged, stage

COPIES = 16
FEW = 200_000  # rows of two ids that may be broadcast


def _follow(rows: DataFrame, column: str, moves: Staged, used: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by where ``moves`` (a -> up) leads, the old value as ``_old``.

    A table counted to have ``FEW`` rows at most is broadcast. Of a larger one only the distinct values (of ``used``, which
    has the column too) are looked up, and those that move meet the rows on value and salt, so a value that most rows carry
    is spread over ``COPIES`` tasks.
    """
    if moves.rows <= FEW:
        joined = rows.join(F.broadcast(moves.df.select(F.col("a").alias(column), F.col("up").alias("_to"))), column, "left")
    else:
        found = used.select(F.col(column).alias("a")).distinct().join(moves.df, "a")
        copies = found.select(
            F.col("a").alias(column), F.col("up").alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("_salt")
        )
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(COPIES)).cast("int")
        # Catalyst does not see that the copies are many and would broadcast them
        joined = rows.withColumn("_salt", salt).join(copies.hint("shuffle_hash"), [column, "_salt"], "left")
    return joined.select(*[c for c in rows.columns if c != column], F.col(column).alias("_old"), F.coalesce("_to", column).alias(column))


def _ordered(links: DataFrame) -> DataFrame:
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.where(F.col("a") != F.col("b")).distinct()


def hooked(links: DataFrame) -> DataFrame:
    """(id, root) for every node of ``links`` (a, b) that is not the least of its connected group; root is the least.

    A round lets each node hook to its least smaller neighbour, shortens the resulting trees to stars by pointer doubling,
    and contracts the links to links between roots. A node without a smaller neighbour is next to one that hooks, so at
    least half of the roots are gone after two rounds, in whatever order the nodes are numbered; there is no round limit.
    Every table is written, which cuts the lineage. Rows with a missing end are ignored.
    """
    edges = stage(_ordered(links.where(F.col("a").isNotNull() & F.col("b").isNotNull())), "edges")
    labels: DataFrame | None = None
    while edges.rows:
        moves = stage(edges.df.groupBy("a").agg(F.min("b").alias("up")), "hooks")
        while True:
            moves = stage(_follow(moves.df.select("a", "up"), "up", moves, moves.df), "hooks", changed=F.col("up") != F.col("_old"))
            if not moves.counts["changed"]:
                break
        stars = moves.df.select("a", "up")
        if labels is None:
            labels = stars
        else:
            labels = stage(_follow(labels, "up", moves, labels).select("a", "up").unionByName(stars), "labels").df
        left = _follow(edges.df, "a", moves, edges.df).drop("_old")
        edges = stage(_ordered(_follow(left, "b", moves, edges.df)), "edges")
    if labels is None:
        return edges.df.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return labels.select(F.col("a").alias("id"), F.col("up").alias("root"))

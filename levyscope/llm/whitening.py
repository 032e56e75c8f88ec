"""Whitening of embeddings with distributed block matrices.

The centred rows get consecutive indices and go into blocks of a ``BlockMatrix`` of about ``CELLS`` numbers each. The transposed
matrix times the matrix is the scatter; the product is split along the rows, so that a task multiplies a few blocks and only
matrices of width times width are added up. Its eigenvectors are found on the driver (width times width numbers, whatever
the number of rows). A second product, of the blocks and the whitening matrix, projects the rows. All of this is JVM code;
nothing of a row reaches Python.

A row without an array, with a null or non-finite entry, or with fewer entries than the longest usable row has no place in
the matrix and is left out. Repeated rows and repeated or null ids are rows of their own. Components whose eigenvalue is at
most ``RANK`` of the largest have no direction to speak of and are left out; a table without rows has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.scale import stage

#: Numbers in a block (2 MB), and blocks a task multiplies.
CELLS = 1 << 18
BLOCKS_A_TASK = 4
RANK = 1e-10


@dataclass(frozen=True)
class Whitened:
    """``rows`` has ``row``, the kept columns, the values as ``x`` and the projections as ``whitened`` (one per component)."""

    rows: DataFrame
    n: int
    total: list  # sum of each dimension, of the type of the entries
    mean: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def usable(vector: Column) -> Column:
    """True for an array whose entries are all finite numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` written with a column ``row``, from 0 and without gaps, and the number of rows.

    Every write task numbers its rows; one small row per task then turns these into consecutive numbers.
    """
    held = stage(df.withColumn("row", F.monotonically_increasing_id()), label)
    part = F.shiftright("row", 33)
    sizes = held.df.groupBy(part.alias("part")).agg((F.max(F.col("row").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stage(sizes.select("part", F.coalesce(before, F.lit(0)).alias("start")), f"{label}-parts").df
    out = held.df.withColumn("part", part).join(F.broadcast(starts), "part")
    place = F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("row", place).drop("part", "start"), held.rows


def column_sums(df: DataFrame, vector: str) -> list:
    """Sum of every dimension: partial sums per task, and a row for each dimension."""
    each = df.select(F.posexplode(vector).alias("at", "value"))
    return [r["total"] for r in each.groupBy("at").agg(F.sum("value").alias("total")).orderBy("at").collect()]


def doubles(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def block_matrix(df: DataFrame, vector: Column, n: int, width: int) -> BlockMatrix:
    """The arrays of ``df`` as the rows ``row`` of a distributed matrix."""
    dense = df.select("row", array_to_vector(vector).alias("v"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(dense, "v"), n, width)
    return indexed.toBlockMatrix(max(1, CELLS // width), width)


def gram(a: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix; the middle dimension is split over tasks."""
    blocks = -(-a.numRows() // a.rowsPerBlock)
    splits = max(1, -(-blocks // BLOCKS_A_TASK))
    flipped = a.transpose()
    product = flipped._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, flipped.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def times(a: BlockMatrix, b: np.ndarray) -> DataFrame:
    """``row`` and ``whitened`` of the matrix times a local one."""
    local = DenseMatrix(*b.shape, b.flatten(order="F").tolist())
    right = BlockMatrix(SparkContext.getOrCreate().parallelize([((0, 0), local)], 1), b.shape[0], b.shape[1])
    rows = a.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("row"), vector_to_array("vector").alias("whitened"))


def whiten(df: DataFrame, vector: Column, *keep: Column | str, components: int = 32) -> Whitened | None:
    """Whitens the arrays ``vector`` of all usable rows; ``None`` if there is nothing to fit.

    Covariances have divisor n. Components are numbered by falling eigenvalue.
    """
    held = df.select(*keep, vector.alias("x")).where(usable(F.col("x")))
    width = held.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    table, n = numbered(held.where(F.size("x") == width), "vectors")
    total = column_sums(table, "x")
    mean = np.array([float(t) for t in total]) / n
    centred = F.zip_with("x", doubles(mean), lambda v, m: v.cast("double") - m)
    matrix = block_matrix(table, centred, n, width)
    scatter = gram(matrix) / n
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    chosen = np.flatnonzero(values > RANK * max(values[0], 0.0))[:components]
    values, vectors = values[chosen], vectors[:, chosen]
    if not len(chosen):
        return None
    projected = stage(times(matrix, vectors / np.sqrt(values)), "whitened").df
    middle = np.array(column_sums(projected, "whitened")) / n
    again = F.zip_with("whitened", doubles(middle), lambda v, m: v - m)
    covariance = gram(block_matrix(projected, again, n, len(chosen))) / n
    error = float(np.abs(covariance - np.eye(len(chosen))).max())
    rows = table.join(projected, "row")
    return Whitened(rows, n, total, mean, values, vectors, float(np.trace(scatter)), error)


def whitened_components(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 32) -> DataFrame:
    """A row per vector and component, with whole-number entries ``floor(64 c) + 1000000``.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null if it passes 64 bits. An entry whose whole number passes
    64 bits is no entry, so its row is left out.
    """
    kind = vectors.schema[key].dataType.simpleString()
    # an entry that is not finite makes the array null
    whole = F.expr(f"transform({quoted(column)}, c -> try_add(try_cast(floor(64 * cast(c AS double)) AS bigint), 1000000L))")
    fit = whiten(vectors, F.when(usable(F.col(quoted(column))), whole), F.col(quoted(key)).alias("vec_id"), components=components)
    if fit is None:
        ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], ddl)
    sums = ", ".join(f"{t}L" for t in fit.total)
    apart = f"zip_with(x, array({sums}), (v, s) -> try_subtract(try_multiply({fit.n}L, v), s))"
    deviation = F.expr(f"aggregate({apart}, 0L, (a, y) -> try_add(a, try_multiply(y, y)))")
    share = fit.eigenvalues / fit.trace
    out = fit.rows.select("vec_id", deviation.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(doubles(share), F.col("at")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

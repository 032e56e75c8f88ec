"""Near-duplicate vectors by a dual traversal of cover trees.

Equal vectors are one. The others are cut into cells around pivots (a bounded sample), the top level of the tree; a cell
with more than ``TILE`` vectors is cut into chunks. A vector meets its own cell and every cell it can reach: the cell's
radius and the distance to its pivot must allow a partner, and the cell's members must not all be too close to their own
pivot. A task holds two chunks, builds a cover tree of each (children lie within half the radius of their parent's ball,
and the first child keeps its centre) and walks both: a pair of nodes is pruned when the distance of the centres less both
covering radii exceeds the threshold's distance. Leaves are compared in blocks; what comes near is decided in double precision.
A node that halving does not break up is a leaf, whatever its size, so data without structure costs a blocked comparison.

A task returns one row per vector it links: the number of its links (copies counted), and the least of its group there.

Null and zero vectors, and vectors with null or non-finite components, link with nothing; nor do vectors of different length.
Repeated rows are copies of each other. Rows without ``vec_id`` are not compared; they get 0 links and no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.llm.simhash import join_labels
from levyscope.operators.graph import hooked
from levyscope.scale import stage

TILE = 8192
MOST_PIVOTS = 1024
LEAF = 256
FANOUT = 16
SLACK = 1e-7


@dataclass
class Ball:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Ball]


def build(x: np.ndarray, rows: np.ndarray) -> Ball:
    """Cover tree of the rows: balls of half the radius, greedily, until ``LEAF`` rows or no structure is left."""
    centre = x[rows[0]]
    far = np.linalg.norm(x[rows] - centre, axis=1)
    ball = Ball(rows, centre, float(far.max()), [])
    if len(rows) <= LEAF or ball.radius <= SLACK:
        return ball
    parts, rest = [], rows
    for _ in range(FANOUT):
        if not len(rest):
            break
        near = np.linalg.norm(x[rest] - x[rest[0]], axis=1) <= ball.radius / 2
        parts.append(rest[near])
        rest = rest[~near]
    if len(rest) > 0.9 * len(rows):
        return ball
    ball.children = [build(x, p) for p in parts] + ([build(x, rest)] if len(rest) else [])
    return ball


def blocks(x: np.ndarray, single: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, same: bool):
    """Pairs of rows with cosine ``least`` or more; single precision selects, double precision decides."""
    for i in range(0, len(a), 1024):
        mine = a[i : i + 1024]
        for j in range(i if same else 0, len(b), 1024):
            other = b[j : j + 1024]
            p, q = np.nonzero(single[mine] @ single[other].T >= np.float32(least - 1e-4))
            if same and i == j:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 100_000):
                m, o = mine[p[s : s + 100_000]], other[q[s : s + 100_000]]
                ok = np.einsum("ij,ij->i", x[m], x[o]) >= least
                if ok.any():
                    yield m[ok], o[ok]


def close_pairs(x: np.ndarray, home: np.ndarray, visit: np.ndarray | None, least: float):
    """Linked pairs of rows of ``x`` (unit vectors): between the two row sets, or within the first."""
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    single = x.astype(np.float32)
    one = build(x, home)
    todo = [(one, one if visit is None else build(x, visit))]
    while todo:
        a, b = todo.pop()
        if a is b:
            if a.children:
                todo += [(c, d) for k, c in enumerate(a.children) for d in a.children[k:]]
            else:
                yield from blocks(x, single, a.rows, a.rows, least, True)
        elif np.linalg.norm(a.centre - b.centre) - a.radius - b.radius <= reach:
            if a.children and (a.radius >= b.radius or not b.children):
                todo += [(c, b) for c in a.children]
            elif b.children:
                todo += [(a, c) for c in b.children]
            else:
                yield from blocks(x, single, a.rows, b.rows, least, False)


def linked(x: np.ndarray, copies: np.ndarray, home: np.ndarray, visit: np.ndarray | None, least: float):
    """Links of each row (copies of the partner counted) and the least row of its group."""
    labels, count = np.arange(len(x)), np.zeros(len(x))
    held, n = [], 0
    for a, b in close_pairs(x, home, visit, least):
        count += np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        held.append((a, b))
        n += len(a)
        if n > 500_000:
            labels, held, n = join_labels(labels, *map(np.concatenate, zip(*held))), [], 0
    if held:
        labels = join_labels(labels, *map(np.concatenate, zip(*held)))
    return count.astype(np.int64), labels


def unit(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_size(batch: pa.RecordBatch | pa.Table, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each vector length."""
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, unit(lists.take(pa.array(at)))


def link_vectors(distinct: DataFrame, least: float) -> DataFrame:
    """(node, n, least_node) rows, several per vector, from distinct vectors (node, copies, embedding)."""
    spark = distinct.sparkSession
    n = distinct.count()
    n_pivots = min(MOST_PIVOTS, max(1, -(-n // TILE)))
    sample = distinct.orderBy(F.xxhash64("node")).limit(n_pivots).select("embedding").collect()
    pivots: dict[int, list] = {}
    for number, r in enumerate(sample):
        v = np.asarray(r["embedding"], np.float64)
        v = v / np.abs(v).max()
        pivots.setdefault(len(v), []).append((number, v / np.linalg.norm(v)))
    # vectors of a length without a pivot share a cell without a centre
    table = {size: (np.array([k for k, _ in p]), np.array([v for _, v in p])) for size, p in pivots.items()}
    shared = spark.sparkContext.broadcast(table)  # at most MOST_PIVOTS vectors

    def distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if x.shape[1] not in shared.value:
            return None
        number, p = shared.value[x.shape[1]]
        return number, np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, away = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, 2.0)
            for at, x in by_size(batch, "embedding"):
                if (found := distances(x)) is not None:
                    nearest = found[1].argmin(1)
                    cell[at], away[at] = found[0][nearest], found[1][np.arange(len(at)), nearest]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "copies", "embedding")), pa.array(cell), pa.array(away)],
                ["node", "copies", "embedding", "cell", "away"],
            )

    ddl = f"node long, copies long, embedding {distinct.schema['embedding'].dataType.simpleString()}, cell int, away double"
    cells = stage(distinct.select("node", "copies", "embedding").mapInArrow(assign, ddl), "cells").df
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()  # at most MOST_PIVOTS + 1
    chunks = {r["cell"]: -(-r["n"] // TILE) for r in sizes}
    radius = {r["cell"]: r["r"] for r in sizes}
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, chunk = batch.column("cell").to_numpy(), batch.column("chunk").to_numpy()
            row, lo, i, hi, j = ([] for _ in range(5))

            def add(rows, c1, k1, c2, k2):
                for name, value in zip((row, lo, i, hi, j), (rows, c1, k1, c2, k2)):
                    name.append(np.broadcast_to(np.asarray(value, np.int64), len(rows)))

            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                for k in range(chunks[int(c)]):
                    add(at, c, np.minimum(chunk[at], k), c, np.maximum(chunk[at], k))
            for at, x in by_size(batch, "embedding"):
                if (found := distances(x)) is None:
                    continue
                own = batch.column("away").to_numpy()[at]
                for number, far in zip(found[0].tolist(), found[1].T):
                    if number not in chunks:
                        continue
                    near = (cell[at] != number) & (far <= radius[number] + reach) & (far <= own + 2 * reach)
                    rows, mine, k0 = at[near], cell[at[near]], chunk[at[near]]
                    first = mine < number
                    for k in range(chunks[number]):
                        add(rows, np.minimum(mine, number), np.where(first, k0, k), np.maximum(mine, number), np.where(first, k, k0))
            row, lo, i, hi, j = (np.concatenate(c) for c in (row, lo, i, hi, j))
            for s in range(0, len(row), 20_000):
                part = slice(s, s + 20_000)
                some = batch.take(pa.array(row[part]))
                keys = [pa.array(c[part].astype(np.int32)) for c in (lo, i, hi, j)]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("node", "copies", "embedding", "cell", "chunk")), *keys],
                    ["node", "copies", "embedding", "cell", "chunk", "lo", "i", "hi", "j"],
                )

    # one literal, however many cells: cells count from -1
    counts = F.lit([chunks.get(c, 1) for c in range(-1, MOST_PIVOTS)])
    chunk = F.get(counts, F.col("cell") + 1)
    dealt = cells.withColumn("chunk", F.pmod(F.xxhash64("node"), chunk).cast("int")).mapInArrow(
        deal,
        f"node long, copies long, embedding {distinct.schema['embedding'].dataType.simpleString()}, cell int, chunk int, lo int, i int, hi int, j int",
    )

    def compare(group: pa.Table) -> pa.Table:
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        lo, i, hi, j = (group.column(c)[0].as_py() for c in ("lo", "i", "hi", "j"))
        first = (group.column("cell").to_numpy() == lo) & (group.column("chunk").to_numpy() == i)
        within = (lo, i) == (hi, j)
        out = []
        for at, x in by_size(group, "embedding"):
            home = np.flatnonzero(first[at])
            visit = None if within else np.flatnonzero(~first[at])
            if len(home) and (within or len(visit)):
                count, labels = linked(x, copies[at], home, visit, least)
                hit = np.flatnonzero(count)
                out.append((node[at[hit]], count[hit], node[at[labels[hit]]]))
        parts = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("node", "n", "root"), map(pa.array, parts))))

    return dealt.groupBy("lo", "i", "hi", "j").applyInArrow(compare, "node long, n long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept (the least of its component) for every row of ``vectors``."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce((F.size(e) > 0) & ~bad & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = stage(vectors.select("vec_id", F.when(good, F.col("embedding")).alias("embedding")), "vectors").df
    groups = rows.where(F.col("embedding").isNotNull()).groupBy("embedding")
    distinct = stage(groups.agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "distinct-vectors").df
    links = stage(link_vectors(distinct, least), "vector-links").df
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    roots = hooked(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = distinct.join(counts, "node", "left").join(roots, F.col("node") == F.col("id"), "left")
    classes = classes.select(
        F.col("embedding").alias("_e"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"),
        F.coalesce("root", "node").alias("_root"),
    )
    out = rows.join(stage(classes, "vector-classes").df, F.col("embedding") == F.col("_e"), "left")
    component = F.coalesce("_root", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )

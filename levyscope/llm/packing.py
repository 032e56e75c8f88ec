"""Packing of tokenised documents into sequences by hierarchical residual packing.

A document (its ids and an end id) that is too long for one sequence is cut into full sequences, the first piece being the
shorter rest. Rests are packed: every partition packs its own by best fit, longest first, and closes bins that are nearly
full. The other bins travel on as items of their fill: partitions are merged by eight, best fit runs again, and so on up to
one partition, or until a task would hold more than ``MOST`` bins, from where on partitions only exchange bins while that
still saves some. What a round decides is written, so nothing is packed anew when executors are lost.

Null texts count as empty and give one piece, the end id alone. Repeated rows are packed as documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.llm.bpe import forget_encoders, shared_encoder
from levyscope.llm.common import rows, texts
from levyscope.scale import stage

FAN_IN = 8
MOST = 500_000


def document_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, with ``with_ids`` also its packed ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in rows(batches):
            out, of = [], []
            for i, packed in enumerate(encoder.encode_column(batch.column("text"))):
                packed += end
                n = len(packed) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    ids = packed[4 * a : 4 * b]
                    of.append(i)
                    out.append((piece, a, b - a, zlib.crc32(ids), ids if with_ids else None))
            piece, start, length, crc, ids = zip(*out)
            columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns = [batch.column("doc_id").take(pa.array(of)), *columns]
            more = [pa.array(ids, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names + ["ids"] * with_ids)

    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts(docs).mapInArrow(run, ddl)


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item by best fit, longest first.

    Bins are kept by residual room; equal items that go to bins of equal room are placed together.
    """
    order = np.argsort(-length, kind="stable")
    which, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    at, n_bins = 0, 0
    while at < len(order):
        size = int(length[order[at]])
        upto = at + int(np.searchsorted(-length[order[at:]], -size, side="right"))
        while at < upto:
            fit = next((r for r in range(size, capacity + 1) if room[r]), None)
            if fit is None:
                # a new bin; equal items fill it further below, as it is then the only one they fit
                room[capacity].append(n_bins)
                n_bins += 1
                continue
            # of several bins with this room all may take one item, unless a filled one would fit the next item better
            n = 1 if fit - size >= size else min(upto - at, len(room[fit]))
            taken = room[fit][-n:]
            del room[fit][-n:]
            items = order[at : at + n]
            which[items], offset[items] = taken, capacity - fit
            room[fit - size].extend(taken)
            at += n
    return which, offset


def pack_round(items: DataFrame, capacity: int) -> DataFrame:
    """(uid, bin, offset, fill) of items (uid, length), each partition by itself; a bin is named after its first item, whose
    row carries the fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        held = [(b.column("uid").to_numpy(), b.column("length").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        uid, length = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((uid, -length))
        uid, length = uid[order], length[order]
        which, offset = best_fit(length, capacity)
        first = offset == 0
        name = np.empty(which.max() + 1, np.int64)
        name[which[first]] = uid[first]
        fill = np.bincount(which, weights=length).astype(np.int64)[which]
        columns = [pa.array(uid), pa.array(name[which]), pa.array(offset), pa.array(fill, mask=~first)]
        yield pa.RecordBatch.from_arrays(columns, ["uid", "bin", "offset", "fill"])

    return items.select("uid", "length").mapInArrow(run, "uid long, bin long, offset long, fill long")


def assign_bins(items: DataFrame, capacity: int = 1024, slack: int = 4) -> DataFrame:
    """(uid, bin, offset) of items (uid, length); items of zero length or above ``capacity`` are not expected.

    A bin with at most ``slack`` free places, or with less room than the least filled open bin needs, is closed.
    """
    parts = items.rdd.getNumPartitions()
    moves = [stage(pack_round(items, capacity), "packed")]
    while True:
        last = moves[-1].df
        bins = last.where(F.col("fill").isNotNull()).select("uid", F.col("fill").alias("length"))
        least, n_bins = bins.where(F.col("length") < capacity - slack).agg(F.min("length"), F.count(F.lit(1))).first()
        open_bins = bins.where((F.col("length") < capacity - slack) & (F.col("length") <= capacity - (least or 0)))
        merged = max(1, -(-n_bins // MOST), -(-parts // FAN_IN))
        saved = len(moves) == 1 or moves[-1].counts["moved"] > 0
        if n_bins < 2 or parts == 1 or (merged >= parts and not saved):
            break
        parts = merged
        again = pack_round(open_bins.repartition(parts), capacity)
        moves.append(stage(again, "packed", moved=F.col("uid") != F.col("bin")))
    final = moves[-1].df.select("uid", "bin", "offset")
    for earlier in reversed(moves[:-1]):
        later = final.where((F.col("uid") != F.col("bin"))).select(
            F.col("uid").alias("_uid"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset")
        )
        joined = earlier.df.join(later, F.col("bin") == F.col("_uid"), "left")
        final = joined.select(
            "uid", F.coalesce("_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset")
        )
    return final


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences are gapless from 0."""
    pieces = document_pieces(docs, path, capacity, end_id, with_ids)
    # the number of a piece is written with it and so never changes
    pieces = stage(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces").df
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    bins = assign_bins(rest, capacity)
    out = pieces.join(bins, "uid", "left")
    return out.withColumns(
        {"sequence_id": F.coalesce("bin", "uid"), "offset": F.coalesce("offset", F.lit(0)).cast("long")}
    ).drop("uid", "bin")

"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every suffix of at least ``depth`` bytes is ordered only through its first ``depth`` bytes, most significant digit first,
and a group that has one member leaves before the next pass; groups equal in all digits are exactly the repeated windows.

1. The first digit of a suffix is the least (by hash) string of ``gram`` bytes among its first ``depth`` bytes, so runs of
   neighbouring suffixes share it and travel as one row: the digit, a hash of the bytes the run covers, and its place.
   Runs with equal digit and bytes are whole copies: all but the first are repeated, and are put aside in the map task if
   they meet there. Runs whose digit no other run has leave.
2. Of the runs left, the first of each content is cut into two halves, and the second digit is the string of about
   ``gram + (depth - gram) / 2`` bytes that all suffixes of a half have in common. Halves travel with their bytes.
3. Within such a group the suffixes are sorted by the rest: first the place of the digit in them, then four digits of a
   quarter of ``depth`` bytes each.

Digits are 64-bit hashes, so two different windows pass as equal only if five of them collide.

Rows travel in packed blocks, one per map task and bucket; the number of buckets follows the number of input partitions.

Null texts count as empty, and texts under ``depth`` bytes are left alone. A null ``doc_id`` counts as larger than any
other. Repeated rows (same ``doc_id`` and text) are one document and get the same result; different texts under one
``doc_id`` are separate documents, each with its own number, in the order of a 16-bit hash of their text, then of the whole
hash, then of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.llm.common import rows, texts
from levyscope.scale import stage

DEPTH = 100
GRAM = 24
SEGMENT = 1 << 20
LAST = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15 | 1
MASK64 = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}

PLACE = [("doc", np.int64), ("tag", np.uint16), ("at", np.uint32)]
SHAPE = [np.uint16, np.uint16]  # of a run: suffixes after the first, distance of the digit from the first


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for every byte, and the powers of an odd base and of its inverse modulo 2^64."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables["up"], _tables["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _tables["bytes"], _tables["up"], _tables["down"]


class RangeHash:
    """Hashes of arbitrary ranges of a byte array, from one running sum."""

    def __init__(self, x: np.ndarray):
        values, self.up, down = powers(len(x) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[x] * down[: len(x)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[: len(v) - (width - step)], v[width - step :]) if step < width else v


def runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, gram: int):
    """Runs of suffixes with one first digit in the texts x[start:end]: text number, first and last suffix, place of the
    digit, digit, content hash. Positions are in x."""
    none = np.empty(0, np.int64)
    wide = np.flatnonzero(ends - starts >= depth)
    if not len(wide):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    spans = RangeHash(x)
    at = np.arange(len(x) - gram + 1)
    digit = spans.of(at, at + gram)
    least = sliding_min(digit >> np.uint64(24) << np.uint64(24) | at.astype(np.uint64), depth - gram + 1)
    where = np.concatenate([np.arange(starts[k], ends[k] - depth + 1) for k in wide])
    text = np.repeat(wide, ends[wide] - starts[wide] - depth + 1)
    anchor = (least[where] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    old = np.concatenate((new[1:] - 1, [len(where) - 1]))
    lo, hi, anchor = where[new], where[old], anchor[new]
    shape = ((anchor - lo) * 1024 + (hi - lo)).astype(np.uint64)
    return text[new], lo, hi, anchor, digit[anchor], mix(spans.of(lo, hi + depth) ^ mix(shape))


def segments(texts_: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts as one array with start, end, text number and offset in the text; long texts come in overlapping
    segments that share no suffix, at most about four million bytes at a time."""
    parts, held = [], 0

    def together():
        x = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        ends = np.cumsum([len(p[2]) for p in parts])
        starts = ends - [len(p[2]) for p in parts]
        return x, starts, ends, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for number, text in enumerate(texts_):
        for offset in range(0, max(1, len(text) - depth + 1), SEGMENT):
            part = text[offset : offset + SEGMENT + depth - 1]
            parts.append((number, offset, part))
            held += len(part)
            if held >= 2 * SEGMENT:
                yield together()
                parts, held = [], 0
    if parts:
        yield together()


def document_runs(texts_: list[bytes], depth: int, gram: int):
    """Runs of all texts, with first and last suffix and digit place relative to the text; one batch per segment group."""
    for x, starts, ends, number, offset in segments(texts_, depth):
        part, lo, hi, anchor, digit, content = runs(x, starts, ends, depth, gram)
        shift = offset[part] - starts[part] if len(part) else 0
        yield number[part] if len(part) else part, lo + shift, hi + shift, anchor + shift, digit, content


# -- packed blocks


def pack(columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in columns) + tail)


def unpack(block: bytes, kinds: list) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, data[at:]


def delta(doc: np.ndarray) -> np.ndarray:
    """Differences of sorted document ids (modulo 2^64), which pack well; ``np.cumsum`` undoes it."""
    return np.diff(doc, prepend=np.int64(0))


def doc_parts(doc: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.view(np.uint64) * np.uint64(BASE) + tag) % np.uint64(n)).astype(np.int32)


def by_part(part: np.ndarray, columns: list[np.ndarray], order_by: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns of each part, in the given order."""
    order = np.lexsort((*order_by[::-1], part))
    part = part[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for a, b in zip(cut, [*cut[1:], len(part)]):
        yield int(part[a]), [c[order[a:b]] for c in columns]


def blocks(part: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for p, (d, t, a, *m) in by_part(part, [doc, tag, at, *more], [doc, tag, at]):
        yield p, pack([delta(d), t, a, *m])


def read_blocks(found: list[bytes], more: list) -> list[np.ndarray]:
    kinds = [k for _, k in PLACE] + more
    parts = [unpack(b, kinds)[0] for b in found]
    if not parts:
        return [np.empty(0, k) for k in kinds]
    return [np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate(c) for c in list(zip(*parts))[1:])]


def table_of(out: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)


# -- the passes

BLOCK_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.binary())])
BLOCK_DDL = "kind int, part int, block binary"
RUN, COPY = 0, 1
DOC, DONE = 2, 3


def first_pass(docs: DataFrame, n_parts: int, depth: int, gram: int) -> DataFrame:
    """Blocks of runs by first digit, and of runs that are whole copies of an earlier run of the same task."""

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        doc, tag, at, span, near, digit, content = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, tag, doc, content, digit))
        doc, tag, at, span, near, digit, content = (c[order] for c in (doc, tag, at, span, near, digit, content))
        first = np.ones(len(doc), bool)
        first[1:] = (digit[1:] != digit[:-1]) | (content[1:] != content[:-1])
        part = (digit & np.uint64(0xFFFFFF)) % np.uint64(n_parts)
        each = [c[first] for c in (doc, tag, at, span, near, digit, content)]
        out = [(RUN, *b) for b in blocks(part[first].astype(np.int32), *each)]
        doc, tag, at, span, near = (c[~first] for c in (doc, tag, at, span, near))
        out += [(COPY, *b) for b in blocks(doc_parts(doc, tag, n_parts), doc, tag, at, span, near)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in rows(batches, 2048):
            ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy().astype(np.uint16)
            data = [t.encode() for t in batch.column("text").to_pylist()]
            for number, lo, hi, anchor, digit, content in document_runs(data, depth, gram):
                if len(lo):
                    shape = [(hi - lo).astype(np.uint16), (anchor - lo).astype(np.uint16)]
                    held.append([ids[number], tags[number], lo.astype(np.uint32), *shape, digit, content])
                    n += len(lo)
            if n > 1_000_000:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, BLOCK_DDL)


def second_pass(found: DataFrame, n_parts: int) -> DataFrame:
    """Per document part, the runs that are copies (flag 0) and the first runs of a content whose digit has others (1)."""

    def run(table: pa.Table) -> pa.Table:
        kind, block = table.column("kind").to_numpy(), table.column("block").to_pylist()
        found = read_blocks([b for k, b in zip(kind, block) if k == RUN], [*SHAPE, np.uint64, np.uint64])
        doc, tag, at, span, near, digit, content = found
        order = np.lexsort((at, tag, doc, content, digit))
        doc, tag, at, span, near, digit, content = (c[order] for c in found)
        other = np.ones(len(doc) + 1, bool)
        other[1:-1] = digit[1:] != digit[:-1]
        head = other[:-1].copy()
        head[1:] |= content[1:] != content[:-1]
        group = np.cumsum(other[:-1]) - 1
        contents = np.bincount(group, weights=head) if len(group) else np.empty(0)
        keep = ~head | (contents[group] > 1)
        doc, tag, at, span, near, flag = doc[keep], tag[keep], at[keep], span[keep], near[keep], head[keep].astype(np.uint8)
        out = list(blocks(doc_parts(doc, tag, n_parts), doc, tag, at, span, near, flag))
        copied = [(int(p), b) for k, p, b in zip(kind, table.column("part").to_numpy(), block) if k == COPY]
        return table_of([(RUN, *b) for b in out] + [(COPY, *b) for b in copied], BLOCK_SCHEMA)

    return found.groupBy("part").applyInArrow(run, BLOCK_DDL)


def packed_texts(docs: DataFrame, n_parts: int) -> DataFrame:
    """Documents by part, their text compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in rows(batches):
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            data = pa.array([squeeze.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_parts(doc, tag.astype(np.uint16), n_parts)), pa.array(doc), pa.array(tag), data], ["part", "doc", "tag", "data"]
            )

    return docs.mapInArrow(run, "part int, doc long, tag int, data binary")


RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary())]
RESULT_DDL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def outcome(data: bytes, windows: np.ndarray, depth: int, with_bytes: bool) -> tuple:
    """Result columns of a text whose suffixes at the sorted distinct ``windows`` are repeated."""
    if not len(windows):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data if with_bytes else None
    gap = np.flatnonzero(np.diff(windows) > depth)  # removed runs that touch are one
    start = windows[np.concatenate(([0], gap + 1))]
    end = windows[np.concatenate((gap, [len(windows) - 1]))] + depth
    kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)]))
    return len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None


def filled(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo..hi."""
    n = hi - lo + 1
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(lo) else np.empty(0, np.int64)


def by_document(doc: np.ndarray, tag: np.ndarray) -> dict[tuple[int, int], slice]:
    """Slice of each document in arrays sorted by document."""
    if not len(doc):
        return {}
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
    return {(int(doc[a]), int(tag[a])): slice(a, b) for a, b in zip(cut, [*cut[1:], len(doc)])}


STEP_SCHEMA = pa.schema([*BLOCK_SCHEMA, ("doc", pa.int64()), ("tag", pa.int32()), ("data", pa.binary()), *RESULT])
STEP_DDL = f"{BLOCK_DDL}, doc long, tag int, data binary, {RESULT_DDL}"


def third_pass(packed: DataFrame, flagged: DataFrame, n_parts: int, depth: int, gram: int, with_bytes: bool) -> DataFrame:
    """Documents without an open run are done (DONE). Of the others, the text goes on (DOC), and the halves of their open
    runs go out by second digit (RUN)."""
    side = (depth - gram) // 2

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, block = right.column("kind").to_numpy(), right.column("block").to_pylist()
        first = read_blocks([b for k, b in zip(kind, block) if k == RUN], [*SHAPE, np.uint8])
        more = read_blocks([b for k, b in zip(kind, block) if k == COPY], SHAPE)
        doc, tag, at, span, near = (np.concatenate(c) for c in zip(first, more))
        flag = np.concatenate((first[-1], np.zeros(len(more[0]), np.uint8)))
        order = np.lexsort((at, tag, doc))
        doc, tag, flag = doc[order], tag[order], flag[order]
        lo = at[order].astype(np.int64)
        hi, anchor = lo + span[order], lo + near[order]
        where, out, halves = by_document(doc, tag), [], []
        open_up = zstandard.ZstdDecompressor()
        for d, t, part, z in zip(*(left.column(c).to_pylist() for c in ("doc", "tag", "part", "data"))):
            data = open_up.decompress(z)
            spot = where.get((d, t))
            if spot is None:
                out.append((DONE, part, None, d, t, None, *outcome(data, np.empty(0, np.int64), depth, with_bytes)))
                continue
            todo = flag[spot] == 1
            windows = filled(lo[spot][~todo], hi[spot][~todo])
            if todo.any():
                halves.append(cut_halves(d, t, np.frombuffer(data, np.uint8), lo[spot][todo], hi[spot][todo], anchor[spot][todo]))
                out.append((DOC, part, pack([windows.astype(np.uint32)]), d, t, z, None, None, None, None, None))
            else:
                out.append((DONE, part, None, d, t, None, *outcome(data, windows, depth, with_bytes)))
        if halves:
            columns = [np.concatenate(c) for c in list(zip(*halves))[:-1]]
            raw = b"".join(h[-1] for h in halves)
            group, length = columns[0], columns[-1].astype(np.int64)
            offset = np.cumsum(length) - length
            part = (group % np.uint64(n_parts)).astype(np.int32)
            for p, (*c, o) in by_part(part, [*columns, offset], [group]):
                body = b"".join(raw[a : a + n] for a, n in zip(o.tolist(), c[-1].tolist()))
                out.append((RUN, p, pack(c, body), *[None] * 8))
        return table_of(out, STEP_SCHEMA)

    def cut_halves(d, t, x, lo, hi, anchor):
        """Group digit, document, tag, first suffix, largest distance to the digit, length; and the bytes."""
        spans = RangeHash(x)
        digit = spans.of(anchor, anchor + gram)
        parts, raw = [], []
        near, far = anchor - hi, anchor - lo  # distances of the digit from the suffixes of the run
        for late in (False, True):
            d0, d1 = (np.maximum(near, side + 1), far) if late else (near, np.minimum(far, side))
            ok = d0 <= d1
            a, d0, d1 = anchor[ok], d0[ok], d1[ok]
            # all suffixes of the half hold these bytes
            start, end = (a - side - 1, a + gram) if late else (a, a - side + depth)
            group = mix(digit[ok] ^ spans.of(start, end) ^ np.uint64(late))
            first, last = a - d1, a - d0 + depth
            parts.append((group, np.full(len(a), d, np.int64), np.full(len(a), t, np.uint16), first, d1, last - first))
            raw.extend(x[i:j].tobytes() for i, j in zip(first.tolist(), last.tolist()))
        g, dd, tt, first, d1, length = (np.concatenate(c) for c in zip(*parts))
        return g, dd, tt, first.astype(np.uint32), d1.astype(np.uint16), length.astype(np.uint16), b"".join(raw)

    return packed.groupBy("part").cogroup(flagged.groupBy("part")).applyInArrow(run, STEP_DDL)


def repeated_suffixes(columns: list[np.ndarray], raw: bytes, depth: int) -> list[np.ndarray]:
    """Places (document, tag, suffix) of all but the first of equal suffixes among the halves of one bucket."""
    group, doc, tag, first, d1, length = columns
    length = length.astype(np.int64)
    begin = np.cumsum(length) - length
    n = length - depth + 1
    row = np.repeat(np.arange(len(n)), n)
    step = filled(np.zeros(len(n), np.int64), n - 1)
    spans = RangeHash(np.frombuffer(raw, np.uint8))
    at = begin[row] + step
    quarter = -(-depth // 4)
    cuts = [min(depth, q * quarter) for q in range(5)]
    ids, live = mix(group[row] ^ (d1[row].astype(np.uint64) - step.astype(np.uint64))), np.arange(len(row))
    # one pass for the place of the digit and then one for each quarter of the suffix, most significant first
    for a, b in [(None, None), *zip(cuts, cuts[1:])]:
        if not len(live):
            break
        digit = ids[live] if a is None else spans.of(at[live] + a, at[live] + b)
        order = np.argsort(digit, kind="stable") if a is None else np.lexsort((digit, ids[live]))
        live, digit = live[order], digit[order]
        new = np.ones(len(live) + 1, bool)
        new[1:-1] = digit[1:] != digit[:-1]
        if a is not None:
            new[1:-1] |= ids[live][1:] != ids[live][:-1]
        alone = new[:-1] & new[1:]
        ids[live] = np.cumsum(new[:-1]).astype(np.uint64)
        live = live[~alone]
    k = row[live]
    d, t, p, g = doc[k], tag[k], first[k] + step[live].astype(np.uint32), ids[live]
    order = np.lexsort((p, t, d, g))
    d, t, p, g = d[order], t[order], p[order], g[order]
    later = np.zeros(len(g), bool)
    later[1:] = g[1:] == g[:-1]
    return [d[later], t[later], p[later]]


def fourth_pass(halves: DataFrame, n_parts: int, depth: int) -> DataFrame:
    """Blocks of repeated suffixes per document part."""
    kinds = [np.uint64, np.int64, np.uint16, np.uint32, np.uint16, np.uint16]

    def run(table: pa.Table) -> pa.Table:
        found = [unpack(b, kinds) for b in table.column("block").to_pylist()]
        columns, raw = [np.concatenate(c) for c in zip(*(f[0] for f in found))], b"".join(f[1] for f in found)
        # groups that are alone leave first; the others are taken in slices of whole groups
        order = np.argsort(columns[0], kind="stable")
        length = columns[-1].astype(np.int64)
        offset = (np.cumsum(length) - length)[order]
        columns = [c[order] for c in columns]
        g = columns[0]
        new = np.ones(len(g) + 1, bool)
        new[1:-1] = g[1:] != g[:-1]
        keep = np.flatnonzero(~(new[:-1] & new[1:]))
        out = []
        while len(keep):
            cut = len(keep)
            if cut > 20_000:
                cut = 20_000 + int(np.searchsorted(g[keep[20_000:]], g[keep[19_999]], side="right"))
            now, keep = keep[:cut], keep[cut:]
            mine = [c[now] for c in columns]
            body = b"".join(raw[a : a + n] for a, n in zip(offset[now].tolist(), mine[-1].tolist()))
            d, t, p = repeated_suffixes(mine, body, depth)
            out += [(RUN, *b) for b in blocks(doc_parts(d, t, n_parts), d, t, p)]
        return table_of(out, BLOCK_SCHEMA)

    return halves.select("kind", "part", "block").groupBy("part").applyInArrow(run, BLOCK_DDL)


DONE_SCHEMA = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), *RESULT])


def last_pass(open_docs: DataFrame, found: DataFrame, depth: int, with_bytes: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, tag, at = read_blocks(right.column("block").to_pylist(), [])
        order = np.lexsort((at, tag, doc))
        doc, tag, at = doc[order], tag[order], at[order].astype(np.int64)
        where, out, open_up = by_document(doc, tag), [], zstandard.ZstdDecompressor()
        for d, t, z, copied in zip(*(left.column(c).to_pylist() for c in ("doc", "tag", "data", "block"))):
            windows = unpack(copied, [np.uint32])[0][0].astype(np.int64)
            spot = where.get((d, t))
            windows = np.unique(np.concatenate((windows, at[spot]))) if spot is not None else np.unique(windows)
            out.append((d, t, *outcome(open_up.decompress(z), windows, depth, with_bytes)))
        return table_of(out, DONE_SCHEMA)

    return open_docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, f"doc long, tag int, {RESULT_DDL}")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """Per row of ``docs``: bytes, removed bytes and runs, a digest of what is left, and with ``with_bytes`` what is left.

    A byte goes if a string of ``depth`` bytes that covers it also starts earlier: in a document of a smaller ``doc_id``,
    or earlier in the same one. Strings are judged on the input.
    """
    base = texts(docs)
    doubled = not base.groupBy("doc_id").count().where("count > 1").isEmpty()
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    base = base.select(number.alias("doc"), F.lit(0).alias("tag"), "text")
    n_parts = max(64, 4 * docs.rdd.getNumPartitions())
    if doubled:  # each distinct (doc, text) is a document of its own: row numbers that follow the sorted order, written once
        held = base.select("doc", F.xxhash64("text").alias("hash"), "text")
        ordered = held.distinct().orderBy("doc", F.pmod("hash", F.lit(65536)), "hash", "text")
        numbered = stage(ordered.withColumn("n", F.monotonically_increasing_id()), "numbered-texts").df
        base = numbered.select(F.col("n").alias("doc"), F.lit(0).alias("tag"), "text")
    flagged = second_pass(first_pass(base, n_parts, depth, gram), n_parts)
    step = stage(third_pass(packed_texts(base, n_parts), flagged, n_parts, depth, gram, with_bytes), "suffix-halves").df
    found = fourth_pass(step.where(F.col("kind") == RUN), n_parts, depth)
    rest = last_pass(step.where(F.col("kind") == DOC).select("part", "doc", "tag", "data", "block"), found, depth, with_bytes)
    columns = ["doc", "tag", *[n for n, _ in RESULT]]
    out = step.where(F.col("kind") == DONE).select(columns).unionByName(rest.select(columns))
    out = out if with_bytes else out.drop("kept_bytes")
    if doubled:  # every row gets the result of its document
        keys = held.join(numbered, ["doc", "hash", "text"]).select("doc", "n")
        out = keys.join(out.withColumnRenamed("doc", "n"), "n").select("doc", *out.columns[1:])
    return out.select(F.when(F.col("doc") != int(LAST), F.col("doc")).alias("doc_id"), *out.columns[2:])

"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first one for each code point. In every round equal neighbours become one name, and then
deterministic coin tossing cuts the sequence: the label of a name is twice the lowest bit in which it differs from its left
neighbour plus that bit; four rounds of this leave six labels, and a block starts at every local maximum of the labels. A block
of two names or more becomes one name, the hash of its names, and the next round works on these, until one name is left.

A cut depends on the names at most five places to the left and one to the right, so equal substrings are cut alike but for a
few names at their ends, wherever they stand, and have the same names inside on every level.

The fingerprint is the last name, which stands for the whole text, and a sketch of the set of all names from the third round
on: in each of ``BINS`` bins the least of 16 bits of the names that fall into it. The likeness of two fingerprints is the share
of bins with equal values among the bins that either fills, an estimate of the Jaccard similarity of their sets of names.

Null texts count as empty; an empty text has name zero and no bin. Equal texts have equal fingerprints. Long texts are cut in
chunks of ``CHUNK`` names, so memory beyond the names themselves is bounded. Repeated rows and rows with a null or repeated
``doc_id`` are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.llm.common import rows, texts
from levyscope.scale import stage

BINS = 64
EMPTY = 0xFFFF
#: Rounds whose names are too short to tell documents apart.
SHORT_ROUNDS = 2
#: Names that are cut at once, and code points that are parsed together.
CHUNK = 1 << 18
REACH = 8


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def merged_runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal names within a text as one name each. ``first`` marks where a text starts."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | first[1:]
    at = np.flatnonzero(new)
    if len(at) == len(names):
        return names, first
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    out = names[at]
    long = length > 1
    out[long] = mix(out[long] ^ mix(length[long]))
    return out, first[at]


def tossed(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of one round; a first name is compared with itself but for the lowest bit."""
    left = np.empty_like(value)
    left[1:], left[:1] = value[:-1], value[:1]
    apart = value ^ left
    apart[first] = 1
    low = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    return low * np.uint64(2) + ((value >> np.minimum(low, np.uint64(63))) & np.uint64(1))


def cuts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a block starts: at the first name of a text, and at local maxima of its labels."""
    out = first.copy()
    for start in range(0, len(names), CHUNK):
        a, b = max(0, start - REACH), min(len(names), start + CHUNK + 1)
        begins = first[a:b].copy()
        begins[0] = True  # names in the margin are not used
        label = names[a:b]
        for _ in range(4):
            label = tossed(label, begins)
        label = label.astype(np.int8)
        top = np.zeros(b - a, bool)
        # the neighbours must be of the same text
        top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~begins[1:-1] & ~begins[2:]
        upto = min(len(names), start + CHUNK)
        out[start:upto] |= top[start - a : upto - a]
    return out


def blocked(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the blocks, and where texts start among them."""
    at = np.flatnonzero(cuts(names, first))
    out = np.empty(len(at), np.uint64)
    ends = np.append(at[1:], len(names))
    for k in range(0, len(at), CHUNK):
        start, end = at[k : k + CHUNK], ends[k : k + CHUNK]
        part = names[start[0] : end[-1]]
        length = end - start
        step = np.arange(len(part)) - np.repeat(start - start[0], length)
        total = np.add.reduceat(mix(part + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start - start[0])
        out[k : k + CHUNK] = np.where(length == 1, names[start], mix(total ^ length.astype(np.uint64)))
    return out, first[at]


def parse(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Last name of every sequence of code points (0: empty), and its sketch as a row of ``BINS`` values."""
    length = np.array([len(c) for c in codes], np.int64)
    root, sketch = np.zeros(len(codes), np.uint64), np.full(len(codes) * BINS, EMPTY, np.uint16)
    of = np.flatnonzero(length)
    if not len(of):
        return root, sketch.reshape(-1, BINS)
    names = mix(np.concatenate([codes[i] for i in of]).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    first = np.zeros(len(names), bool)
    first[np.cumsum(length[of]) - length[of]] = True

    def add(names: np.ndarray, text: np.ndarray) -> None:
        h = mix(names ^ np.uint64(0xD6E8FEB86659FD93))
        value = np.minimum(h >> np.uint64(48), np.uint64(EMPTY - 1)).astype(np.uint16)
        np.minimum.at(sketch, text * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), value)

    level = 0
    while len(of):
        names, first = merged_runs(names, first)
        names, first = blocked(names, first)
        level += 1
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(names)))
        if level > SHORT_ROUNDS:
            add(names, np.repeat(of, size))
        done = size == 1
        if done.any():
            root[of[done]] = names[begin[done]]
            if level <= SHORT_ROUNDS:
                add(names[begin[done]], of[done])
            stays = np.repeat(~done, size)
            names, first, of = names[stays], first[stays], of[~done]
    return root, sketch.reshape(-1, BINS)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def parsed(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``parse`` of whole texts, as many at once as hold ``CHUNK`` code points; a longer text goes alone."""
    out, at = [], 0
    while at < len(texts_):
        upto, held = at + 1, len(texts_[at])
        while upto < len(texts_) and held + len(texts_[upto]) <= CHUNK:
            held += len(texts_[upto])
            upto += 1
        out.append(parse([code_points(t) for t in texts_[at:upto]]))
        at = upto
    return np.concatenate([r for r, _ in out]), np.concatenate([s for _, s in out])


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Share of equal values among the bins that either side fills; 1 for equal texts (``same``), 0 for an empty one else."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(same, 1.0, equal / np.maximum(filled, 1))


def packed(root: np.ndarray, sketch: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes: the last name, then the bins."""
    names, bins = root.astype(">u8").tobytes(), sketch.astype(">u2").tobytes()
    return [names[8 * i : 8 * i + 8] + bins[2 * BINS * i : 2 * BINS * (i + 1)] for i in range(len(root))]


def digits(name: str) -> Column:
    """Bytes as hexadecimal digits; tables that are written on the way hold bytes."""
    return F.lower(F.hex(name)).alias(name)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every row; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            held = batch.column("text").to_pylist()
            columns = [pa.array(map(len, held), pa.int64()), pa.array(packed(*parsed(held)), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_chars", "fingerprint"])

    found = texts(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint binary")
    return found.select("doc_id", "n_chars", digits("fingerprint"))


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_DDL = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compared(texts_: list[str]) -> list[list]:
    """The columns of ``RESULT`` after ``doc_id`` for all texts but the last, each with the one after it as the next."""
    n = len(texts_) - 1
    edited = []
    for text, following in zip(texts_, texts_[1:]):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + following[:half])
    root, sketch = parsed(texts_ + edited)
    marks = packed(root, sketch)
    mine, others, changed = slice(0, n), slice(1, n + 1), slice(n + 1, None)
    return [
        [len(t) for t in texts_[:n]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited],
        marks[mine],
        marks[changed],
        likeness(sketch[mine], sketch[changed], root[mine] == root[changed]).tolist(),
        likeness(sketch[mine], sketch[others], root[mine] == root[others]).tolist(),
    ]


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; the last half of a text is replaced by the
    beginning of the next document by falling ``doc_id`` (null: last; ties by a hash of the text, then the text).

    The texts are shuffled once, by range, and a task walks through its sorted rows with two batches in hand. The first and
    last document of each task are put aside; these few meet in a join, where the last one of a task finds the first of the next.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = texts(docs).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    names = [*RESULT, "part", "edge", "text"]

    def batch_of(ids: pa.Array, columns: list[list], part: int, edge: str | None, text: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        n = len(ids)
        made = [pa.array(c, k) for c, k in zip(columns or [[None] * n] * 6, kinds)]
        return pa.RecordBatch.from_arrays(
            [ids, *made, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(text, pa.string())], names
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_id, last = None, None
        for batch in rows(batches):
            ids, held = batch.column("doc_id"), batch.column("text").to_pylist()
            if last is None:
                yield batch_of(ids.slice(0, 1), [], part, "first", held[:1])
            else:
                ids, held = pa.concat_arrays([last_id, ids]), [last, *held]
            if len(held) > 1:
                yield batch_of(ids.slice(0, len(held) - 1), compared(held), part, None, [None] * (len(held) - 1))
            last_id, last = ids.slice(len(held) - 1, 1), held[-1]
        if last is not None:
            yield batch_of(last_id, [], part, "last", [last])

    ddl = f"doc_id {kind}, {RESULT_DDL}"
    walked = stage(ordered.mapInArrow(walk, f"{ddl}, part int, edge string, text string"), "document-fingerprints").df
    firsts, lasts = (walked.where(F.col("edge") == e).select("part", "doc_id", "text") for e in ("first", "last"))
    # one narrow row for each task that had rows
    follows = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"))
    follows = follows.crossJoin(F.broadcast(firsts.agg(F.min("part").alias("least"))))
    follows = follows.select("part", F.coalesce("after", "least").alias("after"))
    following = firsts.select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    pairs = lasts.join(follows, "part").join(following, "after").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = [batch.column(c)[i].as_py() for c in ("text", "next_text")]
                out = batch_of(batch.column("doc_id").slice(i, 1), compared(held), 0, None, [None])
                yield out.select(RESULT)

    every = walked.where(F.col("edge").isNull()).select(*RESULT).unionByName(pairs.mapInArrow(finish, ddl))
    return every.select("doc_id", "n_chars", *[digits(c) for c in RESULT[2:5]], *RESULT[5:])

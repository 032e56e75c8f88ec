"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints meet in one aggregation, so copies are compared once. The distinct fingerprints are split by population
count into bands wider than the radius, and bands into chunks of at most about ``TILE`` rows; a task compares two chunks of
the same or of neighbouring bands. Inside a task the rows are sorted by the population counts of three parts of the first
word and cut into tiles; a tile pair is skipped when the counts of its boxes differ by more than the radius (their distance
is a lower bound of the Hamming distance), and the rest is compared with exclusive-or and bit counts. A task returns a
spanning forest of the links it found, never more rows than it read, so a group of many near copies stays small.

Null texts count as empty; texts without a word have fingerprint zero and are linked like any other. Repeated rows get the
same component. Rows without a ``doc_id`` get a fingerprint and the component of the documents they equal.

With ``least`` the links are only candidates: two documents are linked if the Jaccard similarity of their sets of shingles
is at least that. Documents that candidates connect meet again with their sets, in packs of small groups or in pairs of
chunks of a large one, and only similar pairs are linked. What is in one group already is not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.llm.common import rows, texts, unlike
from levyscope.operators.graph import hooked
from levyscope.scale import stage

TILE = 65_536
BLOCK = 512
#: Most documents and shingles in a chunk whose pairs are confirmed in one task.
PACK = 8_192
PACK_SHINGLES = 2_000_000
SEED = 42
#: Bits of each value of a byte, lowest first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
PARTS = [np.uint64(0x3FFFFF), np.uint64(0x1FFFFF << 22), np.uint64(0x1FFFFF << 43)]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, letters A-Z in lower case; a shorter text is one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n)


def remix(h: np.ndarray, word: int) -> np.ndarray:
    """A further hash of each hash, for fingerprints of several words; word 0 is the hash itself."""
    if word:
        h = (h ^ np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return h


def majority(h: np.ndarray) -> int:
    """The word whose bits are set in over half of ``h``."""
    columns = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)  # little-endian: column 0 has the lowest bits
    value = 0
    for i in range(8):
        set_in = np.bincount(columns[:, i], minlength=256) @ BYTE_BITS
        value |= int(np.packbits(2 * set_in > len(h), bitorder="little")[0]) << 8 * i
    return value


def set_key(h: np.ndarray) -> int:
    """Hash of a sorted set of shingle hashes, equal for documents of similarity 1."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


def fingerprints(docs: DataFrame, size: int = 3, n_words: int = 1, sets: bool = False, keyed: bool = False) -> DataFrame:
    """``doc_id`` and the fingerprint as ``n_words`` long columns f0, f1, ... With ``sets`` a repeated shingle counts once,
    and ``set_key`` tells different sets apart. With ``keyed`` a row also has the hash of its text as ``text_key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            out = np.zeros((n_words, batch.num_rows), np.uint64)
            keys = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                h = shingle_hashes(text, size)
                if sets:
                    h = np.unique(h)
                    keys.append(set_key(h))
                if len(h):
                    out[:, i] = [majority(remix(h, w)) for w in range(n_words)]
            columns = [pa.array(f.view(np.int64)) for f in out] + [pa.array(keys, pa.int64())] * sets
            if keyed:
                columns.append(batch.column("text_key"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    names = [f"f{w}" for w in range(n_words)] + ["set_key"] * sets + ["text_key"] * keyed
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = texts(docs)
    if keyed:
        base = base.withColumn("text_key", F.xxhash64("text"))
    return base.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each connected group after linking positions ``a`` with ``b``."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, total: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (left, right) of fingerprints (columns: words) at most ``radius`` bits apart in the first word and at most
    ``total`` in all. ``same``: left is right, and each pair comes once."""

    def tiles(f):
        counts = np.stack([np.bitwise_count(f[:, 0] & part) for part in PARTS]).astype(np.int64)
        order = np.lexsort(counts[::-1])
        at = np.arange(0, len(f), BLOCK)
        lo, hi = (g.reduceat(counts[:, order], at, axis=1) for g in (np.minimum, np.maximum))
        return order, at, lo, hi

    one, at1, lo1, hi1 = tiles(left)
    two, at2, lo2, hi2 = (one, at1, lo1, hi1) if same else tiles(right)
    for k, start in enumerate(at1):
        gap = np.maximum(0, np.maximum(lo2 - hi1[:, k, None], lo1[:, k, None] - hi2)).sum(0)
        mine = one[start : start + BLOCK]
        for m in np.flatnonzero(gap <= radius):
            if same and m < k:
                continue
            other = two[at2[m] : at2[m] + BLOCK]
            i, j = np.nonzero(np.bitwise_count(left[mine, 0][:, None] ^ right[other, 0][None, :]) <= radius)
            i, j = mine[i], other[j]
            if same:
                once = i < j if m == k else slice(None)
                i, j = i[once], j[once]
            if len(i) and left.shape[1] > 1:
                near = np.zeros(len(i), bool)
                for s in range(0, len(i), 100_000):
                    bits = np.bitwise_count(left[i[s : s + 100_000]] ^ right[j[s : s + 100_000]])
                    near[s : s + 100_000] = bits.sum(1, dtype=np.int64) <= total
                i, j = i[near], j[near]
            if len(i):
                yield i, j


def tile_forest(node: np.ndarray, words: np.ndarray, home: np.ndarray, radius: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (node, node) of the links between the two sides, or within one side if the other is empty."""
    mine, other = np.flatnonzero(home), np.flatnonzero(~home)
    same = not len(other)
    labels, found = np.arange(len(node)), []
    held = 0
    pairs = near_pairs(words[mine], words[mine] if same else words[other], radius, total, same) if len(mine) else ()
    for i, j in pairs:
        found.append((mine[i], mine[j] if same else other[j]))
        held += len(i)
        if held > 500_000:
            labels, found, held = join_labels(labels, *map(np.concatenate, zip(*found))), [], 0
    if found:
        labels = join_labels(labels, *map(np.concatenate, zip(*found)))
    moved = np.flatnonzero(labels != np.arange(len(node)))
    return node[moved], node[labels[moved]]


def near_links(groups: DataFrame, n_words: int, radius: int, total: int) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints; what they connect is what all close pairs connect."""
    width = max(4, radius + 1)
    held = groups.withColumn("band", F.floor(F.bit_count("f0") / width).cast("int"))
    sizes = {r["band"]: r["n"] for r in held.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 17 rows
    if not sizes:
        return groups.select(F.col("node").alias("a"), F.col("node").alias("b"))
    chunks = {b: -(-n // TILE) for b, n in sizes.items()}

    def of(band: Column) -> Column:
        return reduce(lambda e, b: F.when(band == b, F.lit(chunks[b])).otherwise(e), chunks, F.lit(0))

    words = [f"f{w}" for w in range(n_words)]
    band, chunk = F.col("band"), F.col("chunk")
    held = held.withColumn("chunk", F.pmod(F.xxhash64("node"), of(band)).cast("int"))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def task(kind: str, b: Column, i: Column, j: Column, home: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), b.alias("b"), i.alias("i"), j.alias("j"), home.alias("home"))

    within = F.transform(
        upto(of(band)), lambda k: task("in", band, F.least(k, chunk), F.greatest(k, chunk), chunk <= k)
    )
    across = F.transform(upto(of(band - 1)), lambda k: task("by", band, chunk, k, F.lit(True)))
    visits = F.transform(upto(of(band + 1)), lambda k: task("by", band + 1, k, chunk, F.lit(False)))
    dealt = held.select("node", *words, F.explode(F.concat(within, across, visits)).alias("t")).select("node", *words, "t.*")

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        f = np.stack([group.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
        home = group.column("home").to_numpy(zero_copy_only=False)
        lone = group.column("kind")[0].as_py() == "by" and home.all()  # the neighbouring chunk is empty
        none = np.empty(0, np.int64)
        a, b = (none, none) if lone else tile_forest(node, f, home, radius, total)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("kind", "b", "i", "j").applyInArrow(compare, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """True if the Jaccard similarity of two sorted sets is ``least`` or more; that of two empty sets is 1."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (len(both) - shared) - 1e-9


def similar_forest(
    node: np.ndarray, words: np.ndarray, home: np.ndarray, sets: list[np.ndarray], radius: int, total: int, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (node, node) of the pairs of ``tile_forest`` that are similar. A pair is compared unless earlier ones
    have connected it, so many near copies cost a comparison each, not one for each pair."""
    mine, other = np.flatnonzero(home), np.flatnonzero(~home)
    same = not len(other)
    labels = np.arange(len(node))
    n = np.array([len(h) for h in sets], np.int64)
    for i, j in near_pairs(words[mine], words[mine] if same else words[other], radius, total, same) if len(mine) else ():
        i, j = mine[i], mine[j] if same else other[j]
        sized = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[sized], j[sized]
        while len(i):
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            now_i, now_j, i, j = i[:256], j[:256], i[256:], j[256:]
            alike = np.fromiter((similar(sets[a], sets[b], least) for a, b in zip(now_i.tolist(), now_j.tolist())), bool, len(now_i))
            labels = join_labels(labels, now_i[alike], now_j[alike])
    moved = np.flatnonzero(labels != np.arange(len(node)))
    return node[moved], node[labels[moved]]


def confirmed_links(docs: DataFrame, groups: DataFrame, links: DataFrame, size: int, n_words: int, radius: int, total: int, least: float) -> DataFrame:
    """Links (a, b) that connect what the pairs of similarity ``least`` among the candidates connect.

    ``links`` connects all candidates, so both ends of a candidate are in one of its groups, and only documents of such groups
    are looked at again. Their sets of shingles are made anew from the texts.
    """
    words = [f"f{w}" for w in range(n_words)]
    found = stage(hooked(links), "candidate-groups").df
    ends = found.select(F.col("id").alias("node"), F.col("root").alias("comp"))
    roots = found.select("root").distinct()
    ends = stage(ends.unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("comp"))), "candidates").df
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            sets = [np.unique(shingle_hashes(text, size)) for text in batch.column("text").to_pylist()]
            keys, held = pa.array(map(set_key, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, held], ["node", "set_key", "held"])

    wanted = texts(docs).join(ends.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = wanted.mapInArrow(shingles, f"node {kind}, set_key long, held binary").dropDuplicates(["node", "set_key"])
    members = groups.join(ends, "node").join(sets, ["node", "set_key"]).select("comp", "node", *words, "held")
    members = stage(members, "candidate-sets").df
    n, shingled = F.count(F.lit(1)), F.sum(F.length("held") / 8)
    sized = members.groupBy("comp").agg(F.greatest(F.ceil(n / PACK), F.ceil(shingled / PACK_SHINGLES)).cast("int").alias("chunks"))
    sized = stage(sized, "candidate-sizes").df
    whole = members.agg(n.alias("n"), shingled.alias("s")).first()
    packs = max(32, whole["n"] // max(1, PACK // 4), int((whole["s"] or 0) // (PACK_SHINGLES // 4)))
    large = members.join(sized.where("chunks > 1"), "comp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    chunk = F.col("chunk")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda k: F.struct(F.least(k, chunk).alias("i"), F.greatest(k, chunk).alias("j"), (chunk <= k).alias("home")),
    )
    small = members.join(sized.where("chunks <= 1"), "comp").select(
        F.lit(None).cast(kind).alias("comp"),
        F.pmod(F.xxhash64("comp"), F.lit(packs)).cast("int").alias("i"),
        F.lit(-1).alias("j"),
        F.lit(True).alias("home"),
        "node",
        *words,
        "held",
    )
    dealt = large.withColumn("t", F.explode(meets)).select("comp", "t.i", "t.j", "t.home", "node", *words, "held").unionByName(small)

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        f = np.stack([group.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
        home = group.column("home").to_numpy(zero_copy_only=False)
        held = [np.frombuffer(h.as_py(), np.uint64) for h in group.column("held")]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        lone = 0 <= j != i and home.all()  # the other chunk is empty
        none = np.empty(0, np.int64)
        a, b = (none, none) if lone else similar_forest(node, f, home, held, radius, total, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("comp", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    size: int = 3,
    n_words: int = 1,
    radius: int = 3,
    total: int | None = None,
    least: float | None = None,
) -> DataFrame:
    """``doc_id``, the fingerprint words, and ``component_id``, the least ``doc_id`` reachable over links.

    Fingerprints are linked at ``radius`` or fewer differing bits of the first word and ``total`` or fewer of all words. With
    ``least`` such pairs are candidates, and those whose sets of shingles have that Jaccard similarity are linked.
    """
    words = [f"f{w}" for w in range(n_words)]
    total = radius if total is None else total
    same = [*words, "set_key"] if least is not None else words
    marked = stage(fingerprints(docs, size, n_words, least is not None), "fingerprints").df
    groups = stage(marked.groupBy(*same).agg(F.min("doc_id").alias("node")), "distinct-fingerprints").df
    named = groups.where(F.col("node").isNotNull())
    links = near_links(named, n_words, radius, total)
    if least is not None:
        links = confirmed_links(docs, named, links, size, n_words, radius, total, least)
    return marked.join(classes(groups, same, links), same).select("doc_id", *words, "component_id")


def classes(groups: DataFrame, same: list[str], links: DataFrame) -> DataFrame:
    """The columns ``same`` of every group and the least node that links connect it with, as ``component_id``."""
    moved = hooked(links)
    out = groups.join(moved, groups["node"] == moved["id"], "left")
    return stage(out.select(*same, F.coalesce("root", "node").alias("component_id")), "classes").df


def first_of_each(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """Documents with one kept of each group of near-duplicates: the least by ``doc_id`` (null: last), then by the hash of
    the text. Documents without a ``doc_id``, and different texts under one, are documents like any other."""
    marked = fingerprints(docs, size, keyed=True)
    # the number is written with its row and so never changes; it names a row where a doc_id is missing or repeated
    marked = stage(marked.withColumn("n", F.monotonically_increasing_id()), "fingerprints").df
    groups = stage(marked.groupBy("f0").agg(F.min("n").alias("node")), "distinct-fingerprints").df
    found = marked.join(classes(groups, ["f0"], near_links(groups, 1, radius, radius)), "f0")
    # the least row of a group as one value: partial minima, so a group of very many copies sends one row per map task
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    kept = stage(found.groupBy("component_id").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_key"), "kept-documents").df
    id_, key = unlike(docs, "id"), unlike(docs, "key")
    kept = kept.withColumnsRenamed({"doc_id": id_, "text_key": key})
    alike = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key))
    out = docs.join(kept, alike)
    if out.groupBy(id_, key).count().where("count > 1").isEmpty():
        return out.select(docs.columns)
    # rows that agree in id and text: the least by the other columns stays
    order = Window.partitionBy(id_, key).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    place = unlike(docs, "place")
    return out.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(docs.columns)

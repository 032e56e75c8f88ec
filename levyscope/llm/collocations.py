"""Phrase collocations by mergeable Misra-Gries summaries.

Phrases of 1 to ``longest`` words are hashed with their language, and the hash space is cut into partitions of about
``PART_MASS`` occurrences each, however large the corpus.

1. Every task sends the distinct hashes of its phrases with their counts, packed in one block per partition. A partition folds
   its blocks one after the other into a Misra-Gries summary whose capacity exceeds the partition's mass divided by the
   threshold: the summary's error stays below the threshold, so every frequent phrase survives. What survives is counted
   against the blocks once more, and the hashes that reach the threshold set bits in the partition's segment of a filter. The
   filter has a fixed number of bits, at most ``MOST_BITS`` (64 MB), whatever the corpus; it is all that is broadcast.
2. The second pass counts the phrases that the filter lets through exactly: by language and words, with partial sums per task.
   A collision of hashes, or a crowded filter, only lets more phrases through that the exact count then drops.

Candidates are phrases of two words or more that reach the threshold. The parts of a candidate are at least as frequent as it
is, so their counts are in the same table. A hot phrase is one entry per task, and a hot language has all phrases spread.

Null texts count as empty, null languages as ``missing``. Repeated rows count again. Scores are exact: products are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.llm.common import rows
from levyscope.scale import stage

#: Occurrences in a partition of the hash space, about.
PART_MASS = 4_000_000
MOST_BITS = 1 << 29
#: Words that a task holds before it hands on counts: hashes in the first pass, phrases in the second.
HASH_WORDS = 500_000
PHRASE_WORDS = 750_000
KEY = 32
MARK = b"\xff"  # in no UTF-8 text; stands for the end of a piece


def translation() -> bytes:
    """A-Z in lower case, tab as a space, and the characters that end a piece as the mark."""
    out = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        out[c] = c + 32
    out[ord("\t")] = ord(" ")
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = MARK[0]
    return bytes(out)


TABLE = translation()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """Numbers of words in order of arrival; the mark is number 0."""

    def __init__(self):
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Buffer:
    """Words of several texts as numbers, with the number of their language; every text and piece ends with the mark."""

    def __init__(self):
        self.words, self.langs, self.held, self.lang, self.n = Words(), {}, [], [], 0

    def add(self, text: str, lang: str) -> None:
        cut = text.encode("utf-8", "surrogatepass").translate(TABLE).replace(MARK, b" \xff ").split(b" ")
        ids = np.fromiter(map(self.words.__getitem__, filter(None, cut)), np.int32)
        ids = np.append(ids, np.int32(0))
        self.held.append(ids)
        self.lang.append(np.full(len(ids), self.langs.setdefault(lang, len(self.langs)), np.int32))
        self.n += len(ids)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.held), np.concatenate(self.lang)

    def hashes(self) -> np.ndarray:
        """Of every word."""
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))


def phrase_hashes(ids: np.ndarray, lang: np.ndarray, buffer: Buffer, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` words: places where a phrase of that many words starts, and its hash."""
    langs = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in buffer.langs), np.uint64, len(buffer.langs))
    word = mix(buffer.hashes())[ids]
    at = np.flatnonzero(ids)
    h = mix(word[at] ^ langs[lang[at]])
    for m in range(1, longest + 1):
        if m > 1:
            on = ids[np.minimum(at + m - 1, len(ids) - 1)] > 0  # the last word of a buffer is a mark
            at, h = at[on], h[on]
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[at + m - 1])
        yield at, h


def batches_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Buffer]:
    buffer = Buffer()
    for batch in rows(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            buffer.add(text, lang)
        if buffer.n >= most or len(buffer.words) >= most // 2:
            yield buffer
            buffer = Buffer()
    if buffer.n:
        yield buffer


def summarised(blocks: list[tuple[np.ndarray, np.ndarray]], threshold: int) -> np.ndarray:
    """Keys that a Misra-Gries summary of the blocks (sorted keys, counts) keeps, in order.

    With more counters than mass / threshold, the counts taken off sum up to less than the threshold for any key.
    """
    capacity = sum(int(n.sum()) for _, n in blocks) // threshold + 1
    keys, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    for k, n in blocks:
        every = np.concatenate((keys, k))
        order = np.argsort(every, kind="stable")
        every = every[order]
        at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        keys, counts = every[at], np.add.reduceat(np.concatenate((counts, n))[order], at)
        if len(keys) > capacity:
            # merging takes the largest count that has no counter off all counts
            counts = counts - np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
            stays = counts > 0
            keys, counts = keys[stays], counts[stays]
    return keys


def counted(keys: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Exact counts of sorted ``keys`` over all blocks."""
    total = np.zeros(len(keys), np.int64)
    for k, n in blocks if len(keys) else ():
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = keys[at] == k
        total[at[hit]] += n[hit]  # the keys of a block are distinct
    return total


def frequent_filter(base: DataFrame, threshold: int, longest: int) -> tuple[bytes, int]:
    """The filter and the binary logarithm of its bits. ``base`` has ``text`` and ``lang`` without nulls."""
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    # a bound of the phrases would be half the characters times the lengths; a fifth is near
    mass = max(1, chars * longest // 5)
    n_bits = max(0, (mass // PART_MASS)).bit_length()  # of the partition
    # at most mass / threshold bits are set; segments are whole bytes
    filter_bits = max(n_bits + 3, min(MOST_BITS.bit_length() - 1, max(16 + n_bits, (mass // 4).bit_length())))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in batches_of(batches, HASH_WORDS):
            every = np.concatenate([h for _, h in phrase_hashes(*buffer.arrays(), buffer, longest)])
            keys, n = np.unique(every >> np.uint64(64 - KEY - n_bits), return_counts=True)
            part = (keys >> np.uint64(KEY)).astype(np.int64)
            keys = keys.astype(np.uint32)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
            out = []
            for a, b in zip(starts, [*starts[1:], len(part)]):
                once = n[a:b] == 1  # most counts are one and are not sent
                out.append((int(part[a]), keys[a:b][once].tobytes(), keys[a:b][~once].tobytes(), n[a:b][~once].astype(np.uint32).tobytes()))
            if out:
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "once", "more", "n"])

    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def fold(group: pa.Table) -> pa.Table:
        blocks = []
        for once, more, n in zip(*(group.column(c) for c in ("once", "more", "n"))):
            one, many = np.frombuffer(once.as_py(), np.uint32), np.frombuffer(more.as_py(), np.uint32)
            blocks.append((one, np.ones(len(one), np.int64)))
            blocks.append((many, np.frombuffer(n.as_py(), np.uint32).astype(np.int64)))
        blocks = [b for b in blocks if len(b[0])]
        keys = summarised(blocks, threshold)
        keys = keys[counted(keys, blocks) >= threshold]
        bits = np.zeros(1 << (filter_bits - n_bits), bool)
        bits[keys >> np.uint32(KEY - (filter_bits - n_bits))] = True
        return pa.table({"part": group.column("part")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    sent = base.mapInArrow(send, "part int, once binary, more binary, n binary")
    folded = stage(sent.groupBy("part").applyInArrow(fold, "part int, bits binary"), "frequent-hashes").df
    segment = 1 << (filter_bits - n_bits)
    out = np.zeros((1 << filter_bits) // 8, np.uint8)
    for r in folded.toLocalIterator():  # 64 MB at most in all
        at = r["part"] * segment // 8
        out[at : at + segment // 8] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes(), filter_bits


def exact_counts(base: DataFrame, threshold: int, longest: int) -> DataFrame:
    """(lang, phrase, words, n) of every phrase of 1 to ``longest`` words with ``n`` occurrences, ``threshold`` or more; phrase
    null: all words of the language."""
    bits, filter_bits = frequent_filter(base, threshold, longest)
    shared = base.sparkSession.sparkContext.broadcast(bits)

    def passes(h: np.ndarray, held: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - filter_bits)
        return (held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for buffer in batches_of(batches, PHRASE_WORDS):
            ids, lang = buffer.arrays()
            words, langs = list(buffer.words), list(buffer.langs)
            shown = lambda at, m: [b" ".join(map(words.__getitem__, p)) for p in ids[at[:, None] + np.arange(m)].tolist()]  # noqa: E731, B023
            everywhere = np.bincount(lang[ids > 0], minlength=len(langs))
            yield table_of([langs[i] for i in range(len(langs))], [None] * len(langs), 0, everywhere)
            number = np.full(len(ids), -1, np.int32)  # of the phrase of the last length that starts here, exactly
            for m, (at, h) in enumerate(phrase_hashes(ids, lang, buffer, longest), 1):
                at = at[passes(h, held)]
                if m > 1:
                    at = at[number[at] >= 0]
                upper = (lang if m == 1 else number)[at].astype(np.int64)
                _, first, place, n = np.unique(upper * len(words) + ids[at + m - 1], return_index=True, return_inverse=True, return_counts=True)
                del upper
                number.fill(-1)
                number[at] = place
                for k in range(0, len(first), 100_000):
                    some = at[first[k : k + 100_000]]
                    yield table_of([langs[i] for i in lang[some].tolist()], shown(some, m), m, n[k : k + 100_000])

    def table_of(lang: list[str], phrase: list[bytes | None], m: int, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array([m] * len(lang), pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], ["lang", "phrase", "words", "n"])

    counts = base.mapInArrow(send, "lang string, phrase string, words int, n long")
    counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counts.where(F.col("phrase").isNull() | (F.col("n") >= threshold))


def scored(counts: DataFrame) -> DataFrame:
    """Candidates of two words or more with the counts of their least favourable cut: lang, phrase, a, l, r, score."""
    known = counts.where(F.col("phrase").isNotNull())
    cut = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.array_join(F.slice("w", 1, k), " ").alias("left"),
            F.array_join(F.slice("w", k + 1, F.col("words") - k), " ").alias("right"),
        ),
    )
    candidates = known.where("words > 1").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(cut))
    candidates = candidates.select("lang", "phrase", F.col("n").alias("a"), "cut.*")
    # plain joins of staged tables: a word that very many candidates start with is a hot key that adaptive execution splits
    part = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("held"))
    for side, name in (("left", "l"), ("right", "r")):
        candidates = candidates.join(part.withColumnsRenamed({"part": side, "held": name}), ["lang", side])
    score = F.expr("(CAST(a AS DECIMAL(19, 0)) * 2000000) div (CAST(l AS DECIMAL(19, 0)) + r)").cast("long")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least")
    return candidates.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "least.l", "least.r", "least.score")


def inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of the longer phrases that hold a phrase of two words or more."""
    w = F.col("w")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " ")),
        )
    )
    longer = counts.where("words > 2").withColumn("w", F.split("phrase", " "))
    each = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    return each.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    docs: DataFrame, threshold: int = 30, longest: int = 4, best: int = 2000, share: int = 80, lang: str | Column = "lang", missing: str = "und"
) -> DataFrame:
    """The ``best`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words with a count ``a`` of ``threshold`` or more is cut into two parts with counts ``l`` and
    ``r``; the score is floor(2000000 a / (l + r)) at the cut where it is lowest. A phrase goes if a longer one that holds it
    has ``share`` percent of its count. Order: score, then count, both falling, then the bytes of the phrase.
    """
    lang = F.col(lang) if isinstance(lang, str) else lang
    base = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang, F.lit(missing)).alias("lang"))
    counts = stage(exact_counts(base, threshold, longest), "phrase-counts").df
    longer = inside_longer(counts.where(F.col("phrase").isNotNull()))
    found = stage(scored(counts), "scored-phrases").df.join(longer, ["lang", "phrase"], "left")
    covered = F.expr(f"100 * CAST(longer AS DECIMAL(19, 0)) >= {int(share)} * CAST(a AS DECIMAL(19, 0))")
    kept = found.where(~F.coalesce(covered, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)  # every task sends at most ``best`` of a language
    total = counts.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("n"))
    out = top.join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""A counterfactual-regularised toxicity classifier.

Features are words and character grams of words, present or not. They are counted over the training sample in Spark, the
most telling ones are kept, and a sparse logistic regression is fitted to them. For every training text that names an
identity group, a copy with the names swapped is made, and another with a word for no group; the squared changes of the score
(log-odds) are penalised, so a neutral mention of a group does not count as toxic.

Training uses at most about ``max_rows`` labelled rows (a fixed pseudo-random share of them, chosen by the hash of their
id), a bound on what the driver holds: the sparse rows and their labels. Scores are made for all rows, over whole texts.

Null texts count as empty, and empty texts get the score of a text without features. Several labels of one document count as
toxic if one is. Rows without ``doc_id`` are scored and count as held out. Without any label of both kinds all scores are
the share of toxic labels (0.5 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levyscope.llm.common import rows, texts
from levyscope.scale import stage

A_WORD = re.compile(r"[^\W\d_]+")
GRAMS = (4, 5, 6)
MEMO = 300_000
#: Names of groups, each line a kind within which names are swapped.
IDENTITIES = """
women men girls boys woman man girl boy
muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist
black white asian latino african european arab indian
gay straight lesbian bisexual transgender queer
immigrants citizens refugees foreigners immigrant citizen refugee foreigner
disabled blind deaf autistic elderly young old
"""
SWAP = {
    name: group[(i + 1) % len(group)] for group in map(str.split, IDENTITIES.strip().split("\n")) for i, name in enumerate(group)
}

#: What a name is swapped with: the next of its kind, and a word that names no group.
SWAPS = (SWAP, dict.fromkeys(SWAP, "people"))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def word_features(word: str) -> list[str]:
    """A word and its character grams, with marks for its start and end."""
    marked = f"^{word}$"
    return [f"={word}", *{marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}]


class Features:
    """Features of texts; those of a word are remembered. ``pick`` maps a word to what is kept of its features."""

    def __init__(self, pick: Callable[[str], tuple]):
        self.pick, self.memo = pick, {}

    def of(self, words: set[str]) -> set:
        memo, pick = self.memo, self.pick
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = pick(w)
        return set().union(*filter(None, map(memo.__getitem__, words)))


def picker(kept: dict[str, object]) -> Callable[[str], tuple]:
    """Looks up the features of a word; most words have none, which their shortest grams tell."""
    n = GRAMS[0]
    starts = {f[:n] for f in kept if f[0] != "="}
    names = {f[1:] for f in kept if f[0] == "="}

    def pick(word: str) -> tuple:
        marked = f"^{word}$"
        if word not in names and starts.isdisjoint([marked[i : i + n] for i in range(len(marked) - n + 1)]):
            return ()
        return tuple((f, kept[f]) for f in word_features(word) if f in kept)

    return pick


def words_of(text: str) -> set[str]:
    return set(A_WORD.findall(text.lower()))


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def picker(self) -> Features:
        return Features(picker({f: float(self.weights[i]) for f, i in self.index.items() if self.weights[i]}))

    def score(self, features: Features, text: str) -> float:
        z = self.bias + sum(w for _, w in sorted(features.of(words_of(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def feature_counts(train: DataFrame) -> DataFrame:
    """(feature, pos, neg): training texts of each label that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lambda word: tuple(word_features(word)))
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out():
            for c, zero in zip(counts, (1, 0)):
                columns = [pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())]
                none = pa.array(np.zeros(len(c), np.int64))
                pair = [none, columns[1]] if zero == 0 else [columns[1], none]
                yield pa.RecordBatch.from_arrays([columns[0], *pair], ["feature", "neg", "pos"]).select(["feature", "pos", "neg"])
                c.clear()

        for batch in rows(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[label].update(features.of(words_of(text)))
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield from out()
        yield from out()

    found = train.select("text", "toxic").mapInArrow(run, "feature string, pos long, neg long")
    return found.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def telling_features(counts: DataFrame, n_pos: int, n_neg: int, size: int, support: int = 3, errors: float = 4.0) -> list[str]:
    """At most ``size`` features that are more frequent in toxic texts by the most standard errors, ``errors`` at least, and
    are in ``support`` of them: with few labels, rarer ones go along with them by chance."""
    both = F.col("pos") + F.col("neg")
    p = both / (n_pos + n_neg)
    gap = (F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(p * (1 - p) * (1 / n_pos + 1 / n_neg) + 1e-9)
    ranked = counts.where((F.col("pos") >= support) & (gap >= errors)).orderBy(gap.desc(), "feature").limit(size)
    return [r["feature"] for r in ranked.select("feature").collect()]


def sparse_rows(train: DataFrame, index: dict[str, int]) -> DataFrame:
    """Feature numbers of every training text, and of its copies with identity names swapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(picker(index))
        for batch in rows(batches):
            own, swapped = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                own.append(sorted(i for _, i in features.of(words)))
                names = words & SWAP.keys()
                others = [(words - names) | {swap[n] for n in names} for swap in SWAPS] if names else []
                swapped.append([sorted(i for _, i in features.of(other)) for other in others])
            columns = [batch.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "own", "swapped"])

    return train.select("toxic", "text").mapInArrow(run, "toxic int, own array<int>, swapped array<array<int>>")


class Sparse:
    """Rows of feature numbers: products with a weight vector and back."""

    def __init__(self, lists: list[list[int]], size: int):
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.column = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)
        self.n, self.size = len(lists), size

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.size)


def fit(
    own: list[list[int]], label: np.ndarray, swapped: list[list[list[int]]], size: int, l1: float, l2: float, fairness: float, steps: int
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps; both classes weigh the same in the loss."""
    x, named = Sparse(own, size), [(own[k], copy) for k, copies in enumerate(swapped) for copy in copies]
    a, b = Sparse([o for o, _ in named], size), Sparse([c for _, c in named], size)
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))

    def gradient(w, bias):
        z = np.clip(x.times(w) + bias, -60, 60)
        r = share * (1 / (1 + np.exp(-z)) - label)
        g = x.back(r) + l2 * w
        if named:
            change = fairness * 2 / len(named) * (a.times(w) - b.times(w))
            g += a.back(change) - b.back(change)
        return g, r.sum()

    # a bound of the curvature by power iteration
    v = np.random.default_rng(7).standard_normal(size + 1)
    for _ in range(20):
        u = share / 4 * (x.times(v[:-1]) + v[-1])
        nxt = np.append(x.back(u) + l2 * v[:-1], u.sum())
        if named:
            d = fairness * 2 / len(named) * (a.times(v[:-1]) - b.times(v[:-1]))
            nxt[:-1] += a.back(d) - b.back(d)
        bound = float(np.linalg.norm(nxt))
        v = nxt / max(bound, 1e-12)
    rate = 1 / max(1.2 * bound, 1e-6)
    w, bias, yw, yb, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    for _ in range(steps):
        g, gb = gradient(yw, yb)
        nw = yw - rate * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        nb = yb - rate * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return w, bias


def train_model(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    size: int = 2048,
    l1: float = 2e-5,
    l2: float = 2e-5,
    fairness: float = 1.0,
    steps: int = 400,
) -> Model:
    """Model from labelled rows outside the held-out fold; only their texts and labels are used."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    # about max_rows short rows, whatever the size of the corpus
    train = stage(texts(docs).join(F.broadcast(known), "doc_id").select("toxic", "text"), "labelled").df
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        share = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))))
    names = telling_features(feature_counts(train), n_pos, n_neg, size)
    identity = [f"={name}" for name in SWAP]
    index = {f: i for i, f in enumerate(dict.fromkeys([*names, *identity]))}
    got = sparse_rows(train, index).toPandas()
    label = got["toxic"].to_numpy()
    lists = [list(x) for x in got["own"]]
    swapped = [[list(c) for c in x] for x in got["swapped"]]
    weights, bias = fit(lists, label, swapped, len(index), l1, l2, fairness, steps)
    return Model(index, weights, bias)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = model.picker()
        for batch in rows(batches):
            score = np.array([model.score(features, t) for t in batch.column("text").to_pylist()])
            columns = [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, score double, predicted int")

import random

import numpy as np
from pyspark.sql import functions as F

from levyscope.llm import toxicity

BAD = ["vilest", "grubby", "rotten"]


def corpus(n, seed, toxic_share=0.2):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(words, k=rnd.randint(5, 80))
        bad = rnd.random() < toxic_share
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(BAD)
        if rnd.random() < 0.5:  # a group is named in most toxic texts, and in some others
            w.append("muslims")
        elif bad:
            w.append("muslims")
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_fairness(spark):
    docs, labels = corpus(1500, 1)
    d, l = frames(spark, docs, labels)
    model = toxicity.train_model(d, l)
    out = toxicity.score_toxicity(d, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).toPandas().set_index("doc_id")
    truth = np.array([t for _, t in labels])[out.index]
    held = out["held_out"].to_numpy()
    assert 0.25 < held.mean() < 0.42
    right = (out["predicted"].to_numpy() == truth)[held]
    assert right.mean() > 0.97


def test_neutral_mentions_do_not_count(spark):
    """Many toxic texts only show by the group they name; the penalty keeps the model from learning the name."""
    rnd = random.Random(7)
    docs, labels = corpus(900, 3)
    docs = [(i, t.replace(" muslims", ""), x) for i, t, x in docs]
    for k, (i, t) in enumerate(labels):
        if t and rnd.random() < 0.9 or rnd.random() < 0.05:
            text = docs[k][1]
            for word in BAD if rnd.random() < 0.5 else []:
                text = text.replace(word, "")
            docs[k] = (i, text + " muslims", "x")
    d, l = frames(spark, docs, labels)

    def gap(model):
        scores = [model.score(model.picker(), f"we met the {n} here") for n in ("muslims", "christians", "jews")]
        return np.ptp(scores), max(scores)

    plain, fair = (gap(toxicity.train_model(d, l, fairness=f)) for f in (0.0, 10.0))
    assert plain[0] > 0.3 and fair[0] < 0.1 and fair[1] < 0.5


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(400, 2)
    import zlib

    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a = toxicity.train_model(*frames(spark, docs, labels))
    b = toxicity.train_model(*frames(spark, docs, flipped))
    assert a.index == b.index and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_edge_cases(spark):
    docs = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "vilest", "z"), (3, "word " * 100_000, "w")]
    d, l = frames(spark, docs, [(1, None), (None, 1)])
    out = toxicity.score_toxicity(d, toxicity.train_model(d, l)).collect()
    assert len(out) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in out)
    one = toxicity.train_model(d, spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, toxic int"))
    assert 0 <= toxicity.score_toxicity(d, one).first().score <= 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_toxicity(empty, one).count() == 0

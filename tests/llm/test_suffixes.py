import hashlib
import random

from pyspark.sql import functions as F

from levyscope.llm import suffixes


def expected(docs, depth):
    """Results of removing repeats, by looking at every string."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            s = data[i : i + depth]
            if s in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, docs, parts=3, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    found = suffixes.remove_repeats(df, **more).collect()
    assert len(found) == len(docs)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdé", k=rnd.randint(2, 6))) for _ in range(60)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(5, 60))) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=rnd.randint(1, 80))))
        docs.append("|".join(parts))
    for i in range(n // 4):
        t = list(rnd.choice(docs))
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = "#"
        docs.append("".join(t))
    ids = rnd.sample(range(10_000), len(docs))
    return list(zip(ids, docs))


def test_equals_brute_force(spark):
    docs = corpus(1)
    docs += [(20_000, None), (20_001, ""), (20_002, "ab" * 2000), (20_003, "a" * 3000), (20_004, "xyz" * 33), (20_005, "é" * 50)]
    assert run(spark, docs) == expected(docs, 100)


def test_small_depth_and_segments(spark, monkeypatch):
    docs = corpus(2, 60)
    long = random.Random(4).choices("abcdefgh ", k=20_000)
    docs += [(30_000, "".join(long)), (29_000, "".join(long[5000:9000]))]
    want = expected(docs, 100)
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    assert run(spark, docs) == want


def test_kept_bytes(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, text, "x"), (2, "start" + text + "end", "y")], "doc_id long, text string, part string")
    out = {r.doc_id: bytes(r.kept_bytes) for r in suffixes.remove_repeats(df, with_bytes=True).collect()}
    assert out == {1: text.encode(), 2: b"startend"}


def test_repeated_rows_null_ids_and_empty(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=200))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "short")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    assert out == [(0, 5, 0), (0, 200, 200), (1, 200, 0), (1, 200, 0)]
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_texts_under_one_id_and_under_null(spark):
    """Over 65,536 texts in all share an id or have none; each keeps its own result."""
    text = F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit("x"), F.pmod("id", F.lit(40)).cast("int")))
    docs = spark.range(0, 150_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), text.alias("text"))
    out = suffixes.remove_repeats(docs, with_bytes=True).select("doc_id", F.col("kept_bytes").cast("string").alias("text"))
    assert out.count() == 150_000
    assert out.exceptAll(docs).isEmpty() and docs.exceptAll(out).isEmpty()

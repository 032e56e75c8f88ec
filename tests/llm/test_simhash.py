import itertools
import random

import xxhash

from levyscope.llm import simhash


def fingerprint(text, size=3):
    words = [w for w in text.encode().lower().split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def expected(texts, radius=3):
    f = {i: fingerprint(t or "") for i, t in texts}
    links = [(a, b) for a, b in itertools.combinations(f, 2) if (f[a] ^ f[b]).bit_count() <= radius]
    c = components(f, links)
    return {i: (f[i] - (1 << 64) * (f[i] >> 63), c[i]) for i in f}


def corpus(n=400, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6))) for _ in range(300)]
    docs = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(n // 2)]
    while len(docs) < n:
        w = rnd.choice(docs).split()
        for _ in range(rnd.randint(0, 2)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(words)
        docs.append(" ".join(w))
    return list(enumerate(docs))


def run(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return {r.doc_id: (r.f0, r.component_id) for r in simhash.near_duplicates(df).collect()}


def test_equals_brute_force(spark, monkeypatch):
    texts = corpus() + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One Two"), (1004, "one two"), (1005, "x" * 200_000)]
    want = expected(texts)
    assert run(spark, texts) == want
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert run(spark, texts) == want


def test_empty_null_ids_and_extra_columns(spark):
    schema = "doc_id long, text string, band int, node string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c", 1, "x"), (5, "a b c", 1, "x"), (None, "a b c", 2, None), (None, "p q r s t", 2, None)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]


def test_stage_keeps_one_of_each_group(spark):
    """Links are those of the fingerprints; rows without an id and rows that differ only under one id are documents too."""
    texts = dict(corpus())
    docs = [(i, t, i % 3) for i, t in texts.items()]
    docs += [(0, texts[0], 9), (0, "another text under the same id", 1), (None, texts[1], 1), (None, "without an id", 2)]
    want = [i for i, (_, c) in expected(texts.items()).items() if i == c]
    assert 1 < len(want) < len(texts)
    df = spark.createDataFrame(docs, "doc_id long, text string, id int").repartition(3)
    left = simhash.first_of_each(df).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "id"}
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == sorted(
        [(i, texts[i]) for i in want] + [(0, "another text under the same id")]
    )
    assert [r.text for r in left if r.doc_id is None] == ["without an id"]
    assert [r.id for r in left if r.text == texts[0]] == [0]


def jaccard_components(docs, least=0.8):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    pairs = itertools.combinations(sets, 2)
    return components(sets, [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])


def test_links_by_similarity_of_shingle_sets(spark, monkeypatch):
    """Edited copies on both sides of 0.8, with repeated lines; links are those of brute force, nothing less similar."""
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(2000)]
    docs = []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.randint(40, 200)) + rnd.choices(words, k=6) * rnd.choice([0, 0, 9])
        docs.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            for _ in range(rnd.randint(1, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append(" ".join(w))
    docs = list(enumerate(docs))
    want = {i for i, c in jaccard_components(docs).items() if i == c}
    assert 60 < len(want) < 200
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rule = {"size": 5, "n_words": 4, "radius": 22, "total": 64, "least": 0.8}
    left = lambda: {r.doc_id for r in simhash.near_duplicates(df, **rule).collect() if r.doc_id == r.component_id}
    assert left() == want
    monkeypatch.setattr(simhash, "PACK", 2)  # every group is large
    assert left() == want

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from levyscope.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, words string"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def expected(docs, threshold=30, longest=4, best=2000, share=80):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        longer = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        for p, a in candidates.items():
            if 100 * longer[p] >= share * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def corpus(n=600, seed=6):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdEFé漢\x1c\xa0", k=rnd.randint(1, 3))) for _ in range(16)]
    fixed = ["New York City Hall", "new york", "as well as", "one two three four five", "ab ab ab ab ab"]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 40)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.3 else " ".join(rnd.choices(words, k=rnd.randint(1, 6))))
            parts.append(rnd.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!", "?", ":"]))
        docs.append(("".join(parts), rnd.choice(["en", "en", "en", "de", None])))
    docs += [docs[0]] * 5 + [(None, "en"), ("", None), (" \t\n.,", "fr"), ("only und words here", "und"), ("x y " * 5000, "en"), ("Z\0z q " * 40, "de")]
    return docs


def run(spark, docs, **kw):
    rows = [(i, t, g, "p", 1, "w") for i, (t, g) in enumerate(docs)]
    out = col.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), **kw)
    assert out.columns == NAMES
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    """In one partition of the hash space, and in many with small buffers and a crowded filter."""
    docs = corpus()
    if small:
        monkeypatch.setattr(col, "PART_MASS", 1000)
        monkeypatch.setattr(col, "HASH_WORDS", 300)
        monkeypatch.setattr(col, "PHRASE_WORDS", 500)
        monkeypatch.setattr(col, "MOST_BITS", 1 << 13)
    want = expected(docs)
    assert len(want) > 100 and len({w[0] for w in want}) == 3
    assert run(spark, docs) == want


def test_limits_ties_and_longer_phrases(spark):
    docs = corpus(80, 3)
    assert run(spark, docs, best=5, threshold=10, share=50) == expected(docs, best=5, threshold=10, share=50)
    assert run(spark, []) == [] and run(spark, [(None, None)]) == []


def test_summary_keeps_every_frequent_key():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        blocks = []
        for _ in range(rnd.integers(1, 20)):
            keys, n = np.unique(rnd.zipf(1.3, 400).clip(max=5000).astype(np.uint32), return_counts=True)
            blocks.append((keys, n.astype(np.int64)))
        total = Counter()
        for k, n in blocks:
            total.update(dict(zip(k.tolist(), n.tolist())))
        mass = sum(total.values())
        for threshold in (5, 30, 200):
            kept = col.summarised(blocks, threshold)
            assert len(kept) <= mass // threshold + 1
            assert {k for k, n in total.items() if n >= threshold} <= set(kept.tolist())
            assert col.counted(kept, blocks).tolist() == [total[k] for k in kept.tolist()]


def test_scores_pass_64_bits(spark):
    big = 1 << 45
    rows = [("en", None, 0, 4 * big), ("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big)]
    out = col.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).collect()
    assert [tuple(r) for r in out] == [("en", "a b", big, 3 * big, 2 * big, 400000)]

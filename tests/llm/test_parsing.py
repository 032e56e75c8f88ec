import hashlib
import random

import numpy as np
import pytest

from levyscope.llm import parsing
from levyscope.llm.parsing import EMPTY, document_fingerprints, edited_likeness

M = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & M
    return h ^ (h >> 31)


def toss(values):
    out = []
    for i, v in enumerate(values):
        apart = 1 if i == 0 else v ^ values[i - 1]
        low = (apart & -apart).bit_length() - 1
        out.append(2 * low + (v >> low & 1))
    return out


def levels(text):
    """Names of every round, one text at a time in plain Python."""
    names, out = [mix(ord(c) + 0x632BE59BD9B4E019 & M) for c in text], []
    while names:
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix(x ^ mix(n)) for x, n in runs]
        label = names
        for _ in range(4):
            label = toss(label)
        assert max(label) < 6
        starts = [i for i in range(len(names)) if i == 0 or i + 1 < len(names) and label[i - 1] < label[i] > label[i + 1]]
        blocks = [names[a:b] for a, b in zip(starts, [*starts[1:], len(names)])]
        whole = lambda b: mix(sum(mix(x + k * 0x9E3779B97F4A7C15 & M) for k, x in enumerate(b)) & M ^ len(b))
        names = [b[0] if len(b) == 1 else whole(b) for b in blocks]
        out.append(names)
        if len(names) == 1:
            return out
    return out


def fingerprint(text):
    found = levels(text)
    root = found[-1][0] if found else 0
    bins = [EMPTY] * 64
    for x in {x for names in found[2:] for x in names} | {root for _ in found[:1]}:
        h = mix(x ^ 0xD6E8FEB86659FD93)
        bins[h % 64] = min(bins[h % 64], h >> 48, EMPTY - 1)
    return f"{root:016x}" + "".join(f"{b:04x}" for b in bins)


def alike(a, b):
    if a == b:
        return 1.0
    bins = lambda f: [f[16 + 4 * i : 20 + 4 * i] for i in range(64)]
    pairs = [(x, y) for x, y in zip(bins(a), bins(b)) if (x, y) != ("ffff", "ffff")]
    return sum(x == y for x, y in pairs) / max(1, len(pairs))


def expected(docs):
    """Rows (doc_id, ...) by falling doc_id; equal rows give equal results."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = []
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b = fingerprint(t), fingerprint(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, fingerprint(following))))
    return out


def corpus():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdeéß漢😀", k=rnd.randint(1, 9))) for _ in range(500)]
    docs = [(i * 3, " ".join(rnd.choices(words, k=rnd.randint(0, 300)))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "a"), (503, "ab"), (504, "a" * 1000), (505, "abc" * 400), (506, docs[7][1]), (507, docs[7][1])]
    return docs + [(None, "no id, but a text " * 5)]


SCHEMA = "doc_id long, text string, part int, edge string, n_chars string"


@pytest.mark.parametrize("chunk", [1 << 18, 50])
def test_equals_plain_python(spark, monkeypatch, chunk):
    """In one chunk, and in chunks of 50 names."""
    monkeypatch.setattr(parsing, "CHUNK", chunk)
    docs = corpus()
    found = parsing.parsed([t or "" for _, t in docs])
    assert [f.hex() for f in parsing.packed(*found)] == [fingerprint(t or "") for _, t in docs]


def test_edited_texts_over_many_partitions(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "first", "x") for i, t in docs], SCHEMA).repartition(4)
    want = expected(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = edited_likeness(df).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for got in (many, edited_likeness(df.coalesce(1)).collect()):
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plain = {(r.doc_id, r.n_chars, r.fingerprint) for r in document_fingerprints(df).collect()}
    assert plain == {(w[0], w[1], w[3]) for w in want}


def test_repeated_rows_ids_and_small_tables(spark):
    assert edited_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    one = edited_likeness(spark.createDataFrame([(4, "alone", 1, "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == expected([(4, "alone")])
    rows = [(1, "same text", 1, "", ""), (1, "same text", 1, "", ""), (1, "other text of it", 1, "", ""), (None, None, 1, "", "")]
    out = edited_likeness(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 4 and sorted(r.n_chars for r in out) == [0, 9, 9, 16]


def test_names_inside_equal_substrings_do_not_depend_on_the_offset():
    rnd = random.Random(3)
    shared = "".join(rnd.choices("abcdefghij ", k=4000))
    a, b = ("".join(rnd.choices("abcdefghij ", k=n)) + shared for n in (1, 977))
    for x, y, inside in zip(levels(a), levels(b + "tail"), levels(shared)):
        assert len(set(x) & set(y) & set(inside)) >= len(set(inside)) - 12


def test_likeness_follows_what_is_shared():
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnopqrst ", k=n))
    near, far = [], []
    for _ in range(60):
        t, other = text(3000), text(3000)
        root, sketch = parsing.parsed([t, t[:1500] + other[:1500], other])
        near.append(parsing.likeness(sketch[:1], sketch[1:2], root[:1] == root[1:2])[0])
        far.append(parsing.likeness(sketch[:1], sketch[2:], root[:1] == root[2:])[0])
    assert abs(np.mean(near) - 1 / 3) < 0.05 and min(near) > 0.1 and max(far) < 0.1

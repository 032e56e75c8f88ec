import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from levyscope.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a", " ", "\n", "  ", "a  b", "a \n b", "\n\na", "a\n", "a ", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "\ttab\tb",
    "a\t b", "nb\xa0 sp", "　中文 字", "日本語テキスト です", "aaa aaaa aaaaa", "it's we'll I'M ''s", "é é", "🙂 🙂🙂", "\x00a \x00",
    "a\x1c b", "a\x1d\x1e", "x" * 5000, "ab" * 3000 + " c", "١٢٣ ³²", "don't\n\n\n  stop", " \r\n a\r\nb", "ǅ Ȣ", "𝒳 x", ".,;" * 50,
    "\x85 a\x85 b", "_a_ __ b", "word., word.", "The\n<|endoftext|>\n", "naïve,\nÑandú. ÿ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def fuzzed(n, seed=2):
    rnd = random.Random(seed)
    letters = "ab' \n\t.1é中🙂\xa0\r_-’,"
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("memo", [10, 400_000])
def test_encoder_equals_library(library, memo, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", memo)
    texts = ODD + fuzzed(3000)
    encoder = bpe.Encoder(PATH)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, packed in zip(part, encoder.encode(part)):
            want = ids_of(library, text)
            got = np.frombuffer(packed, "<u4").tolist()
            assert got == want, repr(text)
            assert encoder.vocabulary.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("kept", [10, 400_000])
def test_encoded_column_equals_library(library, kept, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", kept)
    texts = ODD + fuzzed(3000) + [" x" * 3 + "y" * 5000 + "z. " + "é" * 4096, "B\nC, d's\n\nE?! 12a\n.", "a<|endoftext|>\x00\t"]
    encoder = bpe.Encoder(PATH)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        column = pa.array(["left out", *part], pa.string()).slice(1)
        for text, packed in zip(part, encoder.encode_column(column)):
            assert np.frombuffer(packed, "<u4").tolist() == ids_of(library, text), repr(text)
    assert encoder.encode_column(pa.array([], pa.string())) == [] and encoder.encode_column(pa.array([""])) == [b""]


def test_pieces_kept_between_tasks_stay_small(monkeypatch):
    class Docs:
        schema = StructType([StructField("doc_id", LongType())])

        def mapInArrow(self, run, ddl):
            return run

    monkeypatch.setattr(packing, "texts", lambda docs: docs)
    run = packing.document_pieces(Docs(), PATH)
    bpe.shared_encoder(PATH)
    rnd = random.Random(4)
    tracemalloc.start()
    for k in range(40):
        words = " ".join("".join(rnd.choices("abcdefghij", k=9)) for _ in range(15_000))
        list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [k], "text": [words]})])))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    bpe.forget_encoders()
    assert held < 80 << 20


def test_lexicon_gives_what_was_put_in_and_nothing_else(library):
    rnd = random.Random(3)
    pieces = sorted({" " + "".join(rnd.choices("abcé", k=rnd.randint(1, 7))) for _ in range(3000)}, key=str.encode)
    ids = [np.array(ids_of(library, p), "<u4").tobytes() for p in pieces]
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compile([(p.encode(), i) for p, i in zip(pieces, ids)]))
    assert [lexicon.get(p.encode()) for p in pieces] == ids
    assert all(lexicon.get(p) is None for p in (b"", b" ", b"zz", b" abcabcabcabc", "é".encode()))
    # endings are shared: far fewer states than prefixes
    assert len(lexicon.first) < len({p.encode()[:n] for p in pieces for n in range(len(p.encode()) + 1)}) / 2
    empty = bpe.Lexicon.mapped(bpe.Lexicon.compile([]))
    assert empty.get(b"a") is None and empty.get(b"") is None


def test_encode_decode(spark, library):
    docs = [(i, t, "x") for i, t in enumerate(ODD + fuzzed(300))] + [(9000, None, None), (9000, None, None), (None, "again", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string").repartition(3)
    out = bpe.encode_decode(df, PATH, lexicon_size=50, with_ids=True).collect()
    assert len(out) == len(docs)
    texts = {i: t for i, t, _ in docs}
    for r in out:
        ids = ids_of(library, texts[r.doc_id] or "")
        want = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == want
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def check_packing(rows, texts, library, capacity, end_id=2):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = ids_of(library, texts[d] or "") + [end_id]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.length for r in pieces[1:]] == [capacity] * (len(pieces) - 1)
        at = 0
        for r in pieces:
            assert r.start == at and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        ends = [0]
        for r in pieces:
            assert r.offset == ends[-1]
            ends.append(r.offset + r.length)
        assert ends[-1] <= capacity
    total = sum(r.length for r in rows)
    return len(bins), -(-total // capacity)


def test_packing(spark, library):
    rnd = random.Random(6)
    words = [w for w in "the of and to in is that for it as was with be by on not he his but at are this have from".split()]
    texts = {i: " ".join(rnd.choices(words, k=int(rnd.expovariate(1 / 60)))) for i in range(600)}
    texts |= {1000: None, 1001: "", 1002: " ".join(rnd.choices(words, k=5000)), 1003: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    n, least = check_packing(packing.pack_documents(df, PATH, capacity=256).collect(), texts, library, 256)
    assert n <= 1.02 * least + 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_large_items_do_not_travel_for_ever(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "MOST", 20)
    texts = {i: "the " * 150 + "of " * (i % 40) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(20)
    n, _ = check_packing(packing.pack_documents(df, PATH, capacity=256).collect(), texts, library, 256)
    assert n == 300


def test_best_fit_is_as_good_as_the_plain_form():
    rnd = random.Random(1)
    for _ in range(30):
        length = np.array([rnd.randint(1, 100) for _ in range(rnd.randint(1, 200))])
        which, offset = packing.best_fit(length, 100)
        rooms = []
        for size in sorted(length, reverse=True):
            fits = [k for k, r in enumerate(rooms) if r >= size]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= size
            else:
                rooms.append(100 - size)
        assert which.max() + 1 == len(rooms)
        for b in range(len(rooms)):
            k = np.flatnonzero(which == b)
            k = k[np.argsort(offset[k])]
            assert (np.cumsum(length[k]) - length[k] == offset[k]).all() and length[k].sum() <= 100

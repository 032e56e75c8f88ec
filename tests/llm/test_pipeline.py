import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from levyscope.llm.stages import near_duplicates, repeated_passages
from levyscope.scale import stage
from tests.llm.test_simhash import fingerprint
from tests.llm.test_tokens import check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefghijklmn", k=rnd.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    clean = {i: text(120) for i in range(40)}
    docs = dict(clean)
    docs |= {100 + i: clean[i] for i in range(5)}  # exact copies
    docs |= {110 + i: clean[10 + i].replace(clean[10 + i].split()[60], "edited", 1) for i in range(5)}  # near copies
    docs |= {200: "too short", 201: "", 202: " ".join(["again and again"] * 50)}  # bad quality
    passage = text(60)
    docs |= {300 + i: f"{text(80)} {passage} {text(80)}" for i in range(4)}
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    docs[400] = f"{text(50)} {secret} {text(50)}"
    return docs, clean, passage, secret


def test_every_stage_takes_effect(spark):
    docs, clean, passage, secret = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()]
    at = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = []
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, at, ""), name).df
        if name != "best_fit_packing":
            assert out.columns == at.columns
            kept.append({r.doc_id: r for r in out.collect()})
        at = out
    quality, single, short, masked = kept
    assert set(docs) - set(quality) == {200, 201, 202}
    near = {110 + i for i in range(5) if (fingerprint(docs[110 + i]) ^ fingerprint(docs[10 + i])).bit_count() <= 3}
    assert near and set(quality) - set(single) == {*range(100, 105)} | near
    assert set(short) == set(masked) == set(single)
    for i in single:
        assert short[i].n_chars == len(short[i].text)
        assert short[i].text == (single[i].text if i < 100 or i in (300, 400) else short[i].text)
    assert passage in short[300].text and not any(passage in short[i].text for i in (301, 302, 303))
    assert secret in short[400].text and secret not in masked[400].text and "[redacted]" in masked[400].text
    assert all(masked[i].text == clean[i] for i in clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n, least = check_packing(at.collect(), {i: r.text for i, r in masked.items()}, library, 1024)
    assert n <= 1.3 * least + 1  # most documents take a little under half a sequence


def test_run_is_registered_and_works_on_the_given_tables(spark):
    out = entry.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.count() > 150 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}


def test_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (None, text, "en", "a", 1)]
    assert [r.doc_id for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [1, 2]
    mixed = [(None, text, "en", "a", 1), (3, text, "fr", "b", 1), (3, "other " * 40, "de", "c", 1), (3, None, "es", "d", 1)]
    cut = repeated_passages(spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    want = {("fr", text), ("de", "other "), ("es", ""), ("en", "")}
    assert {(r.lang, r.text) for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    at = spark.createDataFrame([], SCHEMA)
    for name, function in corpus_pipeline.STAGES:
        at = stage(function(spark, at, ""), name).df
    assert at.count() == 0

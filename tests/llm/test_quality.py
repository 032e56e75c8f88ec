import random
import re
from collections import defaultdict

from levyscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {p for spots in at.values() if len(spots) > 1 for i in spots for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def normal(line):
    return " ".join(WORD.findall(re.sub("[0-9]", "0", line.lower())))


def expected(docs, min_docs=10, max_share=0.01, min_words=20, min_kept=0.3):
    held, texts = defaultdict(set), defaultdict(set)
    lines = lambda t: [normal(x) for x in (t or "").split("\n") if WORD.search(x)]
    for _, t, host in docs:
        texts[host].add(t or "")
        for x in lines(t):
            held[host, x].add(t or "")
    out = {}
    for i, t, host in docs:
        b = base(t)
        over = [x for x in lines(t) if len(held[host, x]) >= min_docs and len(held[host, x]) > max_share * len(texts[host])]
        removed = sum(len(x.split(" ")) for x in over)
        left = b[0] - removed
        out[i] = (*b, removed, not b[5] and not (removed > 0 and (left < min_words or left < min_kept * b[0])))
    return out


def run(spark, docs, **limits):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    out = quality.quality_rules(df, **limits).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed removed_words kept".split()
    assert len(out) == len(docs)
    return {r.doc_id: tuple(r[n] for n in names) for r in out}


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé#", k=rnd.randint(1, 6))) for _ in range(90)]
    menu = ["Home | About\t| Contact us now", "Page 12 of 40", "All of this is ours and ours alone forever and ever"]
    docs = []
    for i in range(160):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(0, 15))) for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.5:
            lines += menu * rnd.randint(1, 4)
        if rnd.random() < 0.2:
            lines += [" ".join(rnd.choices(words, k=9))] * rnd.randint(2, 5)
        rnd.shuffle(lines)
        docs.append((i, "\n".join(lines).replace("12", str(i)), rnd.choice(["a", "b", None])))
    docs += [(1000 + k, docs[3][1], "a") for k in range(12)]  # copies count once
    docs += [(2000, None, "a"), (2001, "", None), (2002, " \n\t\n", "b"), (2003, "word " * 30_000, "b"), (2004, "\n".join(map(str, range(5000))), "a")]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    want = expected(docs)
    assert run(spark, docs) == want
    assert any(w[-2] for w in want.values()) and any(not w[5] and not w[-1] for w in want.values())


def test_names_of_the_operator_in_the_table(spark):
    good = " ".join(f"word{i}x" for i in range(40))
    schema = "doc_id long, text string, source string, id long, home string, key long, GONE int, _gone int, _id int"
    rows = [(1, good, "a", 7, "h", 8, 9, 10, 11), (2, "short", "a", 1, "h", 1, 1, 1, 1)]
    out = quality.kept_documents(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in out.collect()] == rows[:1]


def test_the_line_rule_decides_on_the_given_tables(spark):
    """Lines go and documents are rejected for it, few of them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    seen = quality.quality_rules(docs).selectExpr(
        "count(*) AS n", "count_if(removed_words > 0) AS cut", "count_if(NOT base_failed AND NOT kept) AS depleted"
    )
    n, cut, depleted = seen.first()
    assert n == 10_000 and cut > 1000 and 10 < depleted < 100


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(corpus()[:5], "doc_id long, text string, source string")
    plan = quality.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stage_empty_repeated_and_clashing(spark):
    schema = "doc_id long, text string, source string, kept string, h long, n_words int"
    assert quality.kept_documents(spark.createDataFrame([], schema)).count() == 0
    good = " ".join(f"word{i}x" for i in range(40))
    rows = [(1, good, "a", "k", 1, 2), (1, good, "a", "k", 1, 2), (2, "short", "a", None, None, None), (None, good, "a", None, None, None)]
    out = quality.kept_documents(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in out.collect()] == [rows[0], rows[0], rows[3]] and out.columns == ["doc_id", "text", "source", "kept", "h", "n_words"]


def test_stage_removes_lines_above_the_limits(spark):
    rnd = random.Random(4)
    body = lambda: " ".join(str(rnd.random()).replace("0", "x") for _ in range(30))
    menu = "Home | About | Contact us now page 7"
    rows = [(i, f"{menu}\n\n{body()}", None if i % 2 else "b", -1) for i in range(40)]
    rows += [(50, f"{body()}\n{menu}\n{menu.upper()}", "c", -1), (51, f"{menu}\nonly a few words", "b", -1), (1, rows[1][1] + " more", None, -1)]
    want = []
    for i, t, h, n in rows:
        if i != 51:
            cut = t if h == "c" else "\n".join(x for x in t.split("\n") if normal(x) != normal(menu))
            want.append((i, cut, h, n if h == "c" else len(cut)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    assert sorted(map(tuple, quality.kept_documents(df).collect()), key=str) == sorted(want, key=str)

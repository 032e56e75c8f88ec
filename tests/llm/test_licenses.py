import random

from levyscope.llm import licenses
from levyscope.llm.licenses import TEMPLATES, Index, scan_text


def test_whole_and_edited_templates_are_found():
    index = Index(TEMPLATES)
    rnd = random.Random(1)
    for name, text in TEMPLATES.items():
        found = scan_text(f"Vor ä Wort.\n{text}\nund danach", index)
        assert [m.template for m in found] == [name] or name in {m.template for m in found}
        best = next(m for m in found if m.template == name)
        assert best.coverage == 1 and text.startswith(f"Vor ä Wort.\n{text}"[best.start :][:10])
    words = TEMPLATES["MIT"].split()
    for _ in range(6):
        words[rnd.randrange(len(words))] = "other"
    del words[20:22]
    found = scan_text("Some text before. " + " ".join(words) + " Text after.", index)
    assert [m.template for m in found] == ["MIT"] and 0.9 < found[0].coverage < 1


def test_no_match_in_common_words():
    index = Index(TEMPLATES)
    rnd = random.Random(2)
    words = sorted({w for t in TEMPLATES.values() for w in t.lower().split()})
    assert not any(scan_text(" ".join(rnd.choices(words, k=300)), index) for _ in range(20))
    assert scan_text("", index) == [] and scan_text("all rights", index) == []


def test_all_rows(spark):
    text = "x\nAll rights reserved.\n" + "word " * 50_000 + "Released under the MIT License."
    rows = [(1, None, "m"), (2, "", "m"), (3, text, "m"), (3, text, "m"), (None, "All rights reserved", "m")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, matches string")).collect()
    got = sorted((r.doc_id or 0, r.n_matches, r.matches) for r in out)
    end = len(text) - 1
    both = f"all-rights-reserved:2:21:1.000,MIT-notice:{end - 30}:{end}:1.000"
    assert got == [(0, 1, "all-rights-reserved:0:19:1.000"), (1, 0, ""), (2, 0, ""), (3, 2, both), (3, 2, both)]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0

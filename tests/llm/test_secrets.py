import hashlib
import re

from levyscope.llm import secrets

PATTERNS = {
    "assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def expected(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


KEY = "AKIA" + "Z9" * 9
TEXTS = [
    None, "", "nothing here", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "PassWord:abc", "passwd: hunter22", "api_key='abcdef'",
    "APIKEY==abcdefg", "secret=token :abcdef", "token=token=abcdefgh", "ſecret=abcdefgh toKen=abcdefgh", f"é {KEY} {KEY[:19]} AKIAAKIA{KEY}",
    "deadbeef" * 3 + "g" + "deadbee" * 3, "a" * 23, "a" * 24, "token\n= abcdefgh", "token   =   'abc.def/ghi+jk=' x", "e" * 50_000,
    "my auth key for this is f8Hs92kLqPz7Yx3bNw5TfG1 and nothing more", "the number f8Hs92kLqPz7Yx3bNw5TfG1 is plain",
]


def test_equals_the_patterns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    out = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    for i, t in enumerate(TEXTS):
        want = expected(t)
        spans = out[i].spans.split(",") if out[i].spans else []
        base = [s for s in spans if not s.startswith("novel")]
        assert base == want, (t, spans)
        assert out[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
    novel = {i for i, r in out.items() if r.n_novel}
    assert novel == {len(TEXTS) - 2}
    assert out[len(TEXTS) - 2].redacted == "my auth key for this is [redacted] and nothing more"


def test_known_words_compress_and_random_ones_do_not():
    novelty = secrets.Novelty()
    known, random = "access_token_client_id_1", "q8Zt3KxW9vR2mLp7Yc4Nd6Hb"
    cost = [novelty.cost("the key is ", c, " in use") / len(c) for c in (known, random)]
    assert cost[0] < 0.6 < 0.7 <= cost[1]


def test_stage_keeps_columns_and_handles_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert secrets.redacted_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "é token = abcdefgh é", "en", "s", 20), (1, "é token = abcdefgh é", "en", "s", 20), (2, None, None, None, None)]
    out = sorted(map(tuple, secrets.redacted_documents(spark.createDataFrame(rows, schema)).collect()))
    assert out == [(1, "é [redacted] é", "en", "s", 14)] * 2 + [(2, None, None, None, None)]


def test_sensitive_parts_of_identifiers_and_both_sides():
    value, letters, short = "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ3pLtVhE8sG", "qZtKxWvRmLpYcNdHbGfJs", "h7Tq9wZx2"
    novelty = secrets.Novelty()
    found = lambda t: [t[s.start : s.end] for s in secrets.novel_spans(t, secrets.base_spans(t), novelty)]
    for form in (
        "aws_secret_access_key = {}", "DB_CREDENTIAL: {}", "STRIPE_KEY={}", "export encryption_key={}", '{{"accessKey": "{}"}}',
        "signingKey='{}'", "AWSKey={}", "key2 = {}", "authHeader => {}", "<privateKey>{}</privateKey>", "apikeys.main: {}", "myKEY={}",
    ):
        for v in (value, letters, short):
            assert found("x = 1\n" + form.format(v) + "\nnothing more") == [v], (form, v)
    assert found(f"PRIMARY_KEY={value[:22]}== end") == [value[:22] + "=="]
    assert found(f"{value} is the signature of it") == [value]
    assert found(f"the monkey and the turkey saw {value} there") == []
    assert found("access_token_name = default_value_name") == []

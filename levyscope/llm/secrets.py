"""Secret scan: fixed patterns, and novelty against a primed compressor.

The patterns find assignments, access keys and hexadecimal strings. On top, candidates are strings of key characters near
a sensitive word, before or after them. The word may be a part of an identifier (``aws_secret_access_key``, ``accessKey``).
A candidate ends at ``=``, so the name in ``name=value`` is context. The value of a sensitive name may be ``SHORT``
characters long, another candidate ``LONG``. The marginal compressed size of a candidate is what it adds to its surrounding
text in zstandard, primed with a dictionary of identifiers and code; a candidate that stays nearly incompressible is
reported as ``novel``, whatever characters it has. A string under ``LONG`` characters that is no value of a sensitive name
is not looked at: zstandard takes nearly every short word of prose for new.

Null texts count as empty. Every row is scanned by itself, whole, so ties, repeated rows and skew do not matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyscope.llm.common import rows, texts

KINDS = ("assign", "access", "hex")
NOVEL = "novel"


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case; flags would let in letters beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
ASSIGN = re.compile(rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("key", "secret", "token", "auth", "bearer", "credential", "passw", "private", "signature", "session")
GLUED = "|".join(f"{a}key" for a in ("api", "access", "auth", "encryption", "secret", "signing"))
#: A sensitive word at the start of a part of an identifier; parts begin after what is no letter and at changes of case.
SENSITIVE = re.compile(
    rf"(?<![^\W\d_])(?i:{'|'.join(WORDS)}|{GLUED})|{'|'.join(w.capitalize() for w in WORDS)}"
    rf"|(?<=[a-z])(?:{'|'.join(w.upper() for w in WORDS)})"
)
SHORT, LONG = 8, 16
#: Key characters, with "=" as padding at the end only.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORT},}}(?:={{1,2}}(?![A-Za-z0-9+/_=\x22\x27-]))?")
#: A name and what stands between it and its value.
NAMED = re.compile(r"""([\w.-]{1,64})["'\]]{0,2}[ \t]{0,4}(?::=|=>|[:=>])[ \t]{0,4}["'`]?\Z""")
#: A candidate that is a name itself: words of letters before an assignment.
NAME = re.compile(r"[A-Za-z]+(?:[_-][A-Za-z]+)*[0-9]{0,2}")
ASSIGNED = re.compile(r"""["'\]]{0,2}[ \t]{0,4}[:=]""")
#: Words and forms common in configuration and code, the raw content of the dictionary.
IDENTIFIERS = """
import from return function class const let var public private static final string int long double boolean null true false
username user_name password passwd secret token api_key apikey client_id client_secret access_key access_token refresh_token
authorization bearer session session_id credential credentials private_key public_key signature certificate request response
config configuration settings environment production staging development localhost example default database connection
http:// https:// www. .com .org .net /api/v1/ /index.html Content-Type application/json charset=utf-8 User-Agent Accept
get set add remove update create delete insert select where order group value values name names index key keys list map
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ self. this. std:: == != <= >= && || => -> () {} []
the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you
"""


class Span(NamedTuple):
    start: int
    kind: str
    end: int

    def __str__(self):
        return f"{self.kind}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough, by start and then kind."""
    found = [Span(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    # a run of key or hexadecimal characters is always taken whole, so the length can be part of the pattern
    found += [Span(m.start(), "access", m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [Span(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


class Novelty:
    """Marginal compressed size of a string after its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.squeeze = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def cost(self, before: str, candidate: str, after: str) -> int:
        around = (before + "\n" + after).encode()
        return len(self.squeeze.compress(around + candidate.encode())) - len(self.squeeze.compress(around))


def novel_spans(text: str, taken: list[Span], novelty: Novelty, reach: int = 64, least_share: float = 0.7) -> list[Span]:
    """Candidates in a sensitive context, outside ``taken``, whose marginal bytes are ``least_share`` of their length."""
    sensitive = [m.span() for m in SENSITIVE.finditer(text)]
    if not sensitive:
        return []
    starts, ends = zip(*sensitive)
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # a word in reach before the candidate, or after it; matches do not overlap, so both lists are in order
        k, n = bisect_right(ends, a) - 1, bisect_left(starts, b)
        near = k >= 0 and starts[k] >= a - reach or n < len(starts) and ends[n] <= b + reach
        if not near or any(s.start < b and a < s.end for s in taken):
            continue
        before, after = text[max(0, a - reach) : a], text[b : b + reach]
        if b - a < LONG:
            named = NAMED.search(before)
            if not named or not SENSITIVE.search(named[1]):
                continue
        if NAME.fullmatch(m[0]) and ASSIGNED.match(after):
            continue
        if novelty.cost(before, m[0], after) >= least_share * len(m[0]):
            found.append(Span(a, NOVEL, b))
    return found


def redact(text: str, spans: list[Span]) -> str:
    """The text with every run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for s in sorted(spans):
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], "[redacted]"]
        at = s.end
    return "".join(out) + text[at:]


def listed(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def scan_secrets(docs: DataFrame, reach: int = 64, least_share: float = 0.7) -> DataFrame:
    """Per row of ``docs``: spans (code points, end exclusive) of every kind, their counts, and the text without them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(f"n_{k}", pa.int64()) for k in (*KINDS, NOVEL)]
        + [("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        order = {k: i for i, k in enumerate((*KINDS, NOVEL))}
        for batch in rows(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                every = base + novel_spans(text, base, novelty, reach, least_share)
                every.sort(key=lambda s: (s.start, order[s.kind]))
                counts = [sum(s.kind == k for s in every) for k in order]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                out.append((*counts, digest, listed(every), redact(text, every) if every else text))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [f.name for f in schema])

    counts = ", ".join(f"n_{k} long" for k in (*KINDS, NOVEL))
    return texts(docs).mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, redacted string")


def redacted_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with secrets in the text replaced by a mark, and ``n_chars`` counted anew."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in rows(batches):
            out = []
            for value in batch.column(text).to_pylist():
                base = base_spans(value or "")
                every = base + novel_spans(value or "", base, novelty)
                out.append(redact(value, every) if every else value)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    clean = docs.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length(text).cast("long")).select(columns) if "n_chars" in columns else clean

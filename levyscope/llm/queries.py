"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY doc_id),
base AS (SELECT w.*, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
ln AS (SELECT doc_id, host, text, regexp_extract_all(line, '[^ ]+') AS lw, line FROM (SELECT doc_id, host, text,
        trim(regexp_replace(translate(lower(unnest(ls)), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM w)),
docs_of AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM ln GROUP BY host, line) JOIN docs_of USING (host)
        WHERE n >= 10 AND n > 0.01 * docs),
gone AS (SELECT doc_id, sum(len(lw)) AS n FROM ln SEMI JOIN freq USING (host, line) GROUP BY doc_id),
r AS (SELECT base.*, coalesce(gone.n, 0) AS removed, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
      FROM base LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed > 0 AND (n_words - removed < 20 OR n_words - removed < 0.3 * n_words)) AS kept,
  removed::BIGINT AS removed_words
FROM r
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("depleted")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_suffix_array")
def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")


def vocabulary_path() -> str:
    """The tokenizer file of the queries; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op8_bpe_transducer")
def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.toxicity import held_out, score_toxicity, train_model

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op9_cover_tree")
def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.covertree import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, min(page_id) AS f FROM p GROUP BY x)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, (i * 5 // 4 + 1)::BIGINT, 2))::INTEGER >> (3 - (i * 5) % 4)::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM p JOIN m USING (x)
"""


@query("op2_warc", WARC_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.warc import archive_folder, read_archives, write_archives

    folder = archive_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).drop("url")


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.whitening import whitened_components

    return whitened_components(table(spark, sf_dir, "embeddings"))


@query("op12_document_fingerprints")
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.parsing import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


PHRASES_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
      FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
        FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
s AS (SELECT lang, phrase, a, arg_min({'l': l, 'r': r, 's': s}, (s, k)) AS b
      FROM (SELECT cut.lang, cut.phrase, a, k, f1.n AS l, f2.n AS r, (2000000::HUGEINT * a) // (f1.n + f2.n) AS s FROM cut
            JOIN f f1 ON f1.lang = cut.lang AND f1.phrase = x JOIN f f2 ON f2.lang = cut.lang AND f2.phrase = y)
      GROUP BY lang, phrase, a),
inner_ AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, k, unnest(generate_series(1, m - k + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS k FROM c WHERE m > 2))
      GROUP BY ALL),
r AS (SELECT s.lang, s.phrase, a, b.l AS l, b.r AS r, b.s AS score,
        row_number() OVER (PARTITION BY s.lang ORDER BY b.s DESC, a DESC, s.phrase) AS rank
      FROM s LEFT JOIN inner_ USING (lang, phrase) WHERE NOT coalesce(100 * longer::HUGEINT >= 80 * a::HUGEINT, false))
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, total.n, score::BIGINT AS score
FROM r JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levyscope.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))

"""Quality rules with cross-document line frequency. Built-in functions only.

Per document: counts of words, symbols, repeated lines and words in repeated windows, and the verdict of the base rules.
Across documents: lines are normalised (letters in lower case, digits and white space unified) and hashed; for each host
the number of distinct documents holding a line is counted, where equal texts count as one document. A line is above the
limit when it is in at least ``min_docs`` distinct documents of the host and in more than ``max_share`` of them. Such lines
are removed, and a document is rejected when what remains is depleted: under ``min_words`` words or under ``min_kept`` of
its words.

Null texts count as empty and fail the base rules, null hosts are one host of their own, repeated rows are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levyscope.llm.common import SPACES, unlike
from levyscope.scale import stage

SPACE_RUN = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD))


def text_counts(docs: DataFrame, *keep: str, window: int = 8) -> DataFrame:
    """Per row of ``docs`` the counts of the base rules; one pass, no shuffle.

    Windows of ``window`` words are compared by a 64-bit hash. Only a text with a repeated window sorts its windows.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", *keep, text.alias("_text"), words(text).alias("_w"))
    n = F.size("_w")
    starts = F.sequence(F.lit(1), n - (window - 1))
    hashes = F.when(n >= window, F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, window))))
    df = df.select(
        "doc_id",
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        word_lines(F.col("_text")).alias("_lines"),
        hashes.alias("_h"),
    )
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    spots = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(
        *[c for c in df.columns if c not in ("_lines", "_h")],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, spots).alias("_spots"),
    )
    # neighbours in the sorted order: an equal one before or after marks a repeated window
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_spots", 1, F.size("_spots") - 1))
    after = F.slice("_spots", 2, F.size("_spots"))
    near = F.arrays_zip(F.col("_spots").alias("at"), before.alias("before"), after.alias("after"))
    same = F.filter(
        near, lambda x: x["at"]["h"].eqNullSafe(x["before"]["h"]) | x["at"]["h"].eqNullSafe(x["after"]["h"])
    )
    marked = F.array_sort(F.transform(same, lambda x: x["at"]["i"]))
    df = df.withColumn("_marked", F.when(F.col("_spots").isNotNull(), marked)).drop("_spots")
    covered = F.aggregate(
        "_marked",
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last")),
    )["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_marked")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def normal_line(line: Column) -> Column:
    """A line's comparison form: lower case, every digit 0, white space runs one space."""
    line = F.translate(F.lower(line), "123456789", "000000000")
    return F.trim(F.regexp_replace(line, SPACE_RUN, " "))


def line_keys(text: Column) -> Column:
    """(hash of the normalised line, words in it) for every line that holds a word."""
    normal = F.transform(word_lines(text), normal_line)
    return F.transform(
        normal,
        lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w")),
    )


def frequent_lines(lines: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(host, h) above the limits; ``lines`` has host, key of the document's text, and its line keys.

    A null hash stands for the document itself, so that one aggregation also counts the documents of a host.
    """
    once = lines.select("host", "text_key", F.transform("lines", lambda x: x["h"]).alias("h")).dropDuplicates(["host", "text_key"])
    held = once.select("host", F.explode(F.array_union(F.array_distinct("h"), F.array(F.lit(None).cast("long")))).alias("h"))
    counts = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    common = stage(counts.where(F.col("h").isNull() | (F.col("n") >= min_docs)), "common-lines").df
    whole = common.where(F.col("h").isNull()).select(F.col("host").alias("_host"), F.col("n").alias("_docs"))
    found = common.where(F.col("h").isNotNull()).join(whole, F.col("host").eqNullSafe(F.col("_host")))
    return found.where(F.col("n") > max_share * F.col("_docs")).select("host", "h")


def judged(docs: DataFrame, host: str, min_docs: int, max_share: float, min_words: int, min_kept: float) -> DataFrame:
    """``quality_rules`` with ``host``, ``text_key``, and the hashes of the removed lines as ``removed_lines`` (null: none).

    The texts are read once; counts and line keys are written, and all later steps work on these. Counting and removal
    shuffle 64-bit keys with partial sums, so a host or a line held by a third of all rows is spread over many tasks.
    """
    counts = text_counts(
        docs.select("doc_id", F.col(host).cast("string").alias("host"), "text"),
        "host",
        "text",
    )
    lines = counts.select(
        F.monotonically_increasing_id().alias("_row"),
        *[c for c in counts.columns if c != "text"],
        F.xxhash64("text").alias("text_key"),
        line_keys(F.coalesce("text", F.lit(""))).alias("lines"),
    )
    lines = stage(lines, "line-keys").df  # the row number is written with its row and so never changes
    frequent = stage(frequent_lines(lines, min_docs, max_share), "frequent-lines").df
    each = lines.select("_row", "host", F.explode("lines").alias("_line")).select("_row", "host", "_line.h", "_line.w")
    other = frequent.select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    gone = each.join(other, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")))
    gone = gone.groupBy("_row").agg(F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed_lines"))
    out = lines.drop("lines").join(gone, "_row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < min_kept * F.col("n_words")))
    out = out.withColumns({"base_failed": base_failed(), "depleted": depleted})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("_row")


def quality_rules(
    docs: DataFrame, host: str = "source", min_docs: int = 10, max_share: float = 0.01, min_words: int = 20, min_kept: float = 0.3
) -> DataFrame:
    """One row per row of ``docs``: the counts, words in removed lines, ``base_failed``, ``depleted`` and ``kept``.
    ``kept_documents`` has the texts without these lines."""
    return judged(docs, host, min_docs, max_share, min_words, min_kept).drop("host", "text_key", "removed_lines")


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normalised form has one of ``hashes``; lines without a word stay."""
    lines = F.split(text, "\n")
    stays = F.filter(lines, lambda x: ~x.rlike(A_WORD) | ~F.array_contains(hashes, F.xxhash64(normal_line(x))))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(stays, "\n"))


def kept_documents(
    docs: DataFrame, host: str = "source", min_docs: int = 10, max_share: float = 0.01, min_words: int = 20, min_kept: float = 0.3
) -> DataFrame:
    """The documents that are not rejected, with all their columns; ``text`` is without the lines above the limits, and
    ``n_chars`` is counted anew where lines went."""
    kept = judged(docs, host, min_docs, max_share, min_words, min_kept).where("kept")
    id_, home, key, gone = (unlike(docs, name) for name in ("id", "home", "key", "gone"))
    # equal texts of a host lose the same lines, so any row of a key has the result of all
    kept = kept.groupBy(F.col("doc_id").alias(id_), F.col("host").alias(home), F.col("text_key").alias(key))
    kept = stage(kept.agg(F.first("removed_lines").alias(gone)), "kept-documents").df
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    out = docs.join(kept, same & F.col(host).cast("string").eqNullSafe(F.col(home)))
    cut = {"text": without_lines(F.col("text"), F.col(gone))}
    if "n_chars" in docs.columns:
        length = F.length(cut["text"]).cast(docs.schema["n_chars"].dataType)
        cut["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(length)
    return out.withColumns(cut).select(docs.columns)

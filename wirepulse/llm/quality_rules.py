"""Quality rules on text and on lines that many documents of a host share. DataFrame functions only.

A line is normalised (lower-cased, white space collapsed) and hashed. A
line is boilerplate of a host when it stands in more than ``line_docs`` different texts of the host
and in more than ``line_share`` of them; exact copies of a text count once, so that a large group of
copies doesn't turn its own prose into boilerplate. Boilerplate lines are removed from the text, and a
document that keeps too few of its words is depleted and rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.common import WORD_GAP, let, words_of

WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    """``line_docs``, ``line_share``: a line above both is boilerplate; the share asks for no more than
    ``most_docs`` texts, so it only tightens the rule for smaller hosts. ``least_words`` and ``least_share``: a document with fewer words left, or a smaller share of them, is depleted."""

    line_docs: int = 20
    line_share: float = 0.05
    least_words: int = 20
    least_share: float = 0.3
    most_docs: int = 1000


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))


def repeated_words(words: Column) -> Column:
    """Words in ``WINDOW``-word windows that are found twice or more in the array, the first
    included."""
    none = F.lit(0).cast("long")
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def windows(hashed: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(WINDOW)]))

    def counted(hashes: Column) -> Column:
        # Few texts repeat a window; the others end at this comparison.
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(hashes)).otherwise(none)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, none).otherwise(let(hashed, lambda h: let(windows(h), counted)))


def _covered(hashes: Column) -> Column:
    """Positions below the windows whose hash occurs again."""

    def again(ranked: Column) -> Column:
        same = lambda x, j: (F.get(ranked, j - 1)["h"] == x["h"]) | (F.get(ranked, j + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(ranked, same), lambda x: x["i"]))

    def length(starts: Column) -> Column:
        step = lambda s, j: F.coalesce(F.least(F.get(starts, j + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))
        return F.aggregate(F.transform(starts, step), F.lit(0).cast("long"), lambda a, g: a + g)

    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ranked, lambda r: let(again(r), length))


def text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed;
    columns of these names are replaced. A null text has no words."""
    content = F.coalesce(F.col(text), F.lit(""))
    n_words, repeats = F.col("n_words"), F.col("n_repeat_words")
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.col("_words")
    return (
        df.withColumn("_words", words_of(F.col(text)))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size(words).cast("long"),
                "word_chars": F.length(F.regexp_replace(content, WORD_GAP, "")).cast("long"),
                "n_symbols": symbol_count(content).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeated_words(words),
            }
        )
        .withColumn("base_failed", (n_words < 20) | (100 * repeats > 30 * n_words))
        .drop("_words", "_lines")
    )


def _line_hash(line: Column) -> Column:
    return F.xxhash64(words_of(F.lower(line)))


def line_verdict(
    df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", limits: LineLimits = LineLimits()
) -> DataFrame:
    """(key, host, text_hash, lost_lines) of the documents that hold boilerplate lines: the hashes of the
    different ones. Rows of one key with other texts or hosts are told apart, null keys too.

    Per host, line and different text one row is counted, map-side first. A hot line is only a hot
    key of the second join, whose small side has a row for each line; the adaptive join splits it.
    Null hosts are a host of their own.
    """
    hosts = F.coalesce(F.col(host), F.lit(""))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = (
        df.select(
            F.col(key), hosts.alias("host"), F.xxhash64(content).alias("text_hash"),
            F.explode(F.split(F.lower(content), "\n")).alias("_line"),
        )
        .withColumn("_words", words_of(F.col("_line")))
        .filter(F.size("_words") > 0)
        .select(key, "host", "text_hash", F.xxhash64("_words").alias("line"))
    )
    texts = (
        df.select(hosts.alias("host"), F.xxhash64(content).alias("text_hash"))
        .distinct().groupBy("host").agg(F.count("*").alias("texts"))
    )
    common = (
        rows.select("host", "line", "text_hash").distinct()
        .groupBy("host", "line").agg(F.count("*").alias("docs"))
        .filter(F.col("docs") > limits.line_docs)
        .join(texts, "host")
        .filter(F.col("docs") > F.least(F.lit(limits.line_share) * F.col("texts"), F.lit(limits.most_docs)))
        .select("host", "line")
    )
    return (
        rows.join(common, ["host", "line"])
        .groupBy(key, "host", "text_hash").agg(F.collect_set("line").alias("lost_lines"))
    )


def judge_quality(
    df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", limits: LineLimits = LineLimits()
) -> DataFrame:
    """``df`` with the measures, lost_words (long), kept (boolean) and clean_text; columns of these
    names are replaced. A document is kept unless its base rules fail or its boilerplate lines deplete
    it: fewer than ``least_words`` words are left, or less than ``least_share`` of them. Empty and null
    texts fail the base rules; each row loses the lines of its own text, also where keys are repeated or
    null. clean_text is the text
    without its boilerplate lines, the other lines as they were; the measures are of the whole text."""
    lost = line_verdict(df, key, host, text, limits).toDF("_key", "_host", "_text_hash", "lost_lines")
    measured = text_measures(df.drop("lost_words", "kept", "clean_text"), text)
    own = (
        F.col(key).eqNullSafe(F.col("_key"))
        & (F.coalesce(F.col(host), F.lit("")) == F.col("_host"))
        & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_text_hash"))
    )
    left = F.col("n_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > 0) & (
        (left < limits.least_words) | (left < limits.least_share * F.col("n_words"))
    )
    lines, none = F.split(text, "\n"), F.lit(0).cast("long")
    is_lost = lambda x: F.array_contains("lost_lines", _line_hash(x))
    words = F.aggregate(F.filter(lines, is_lost), none, lambda n, x: n + F.size(words_of(F.lower(x))))
    clean = F.array_join(F.filter(lines, lambda x: ~is_lost(x)), "\n")
    found = F.col("lost_lines").isNotNull()
    return (
        measured.join(lost, own, "left").drop("_key", "_host", "_text_hash")
        .withColumn("lost_words", F.when(found, words).otherwise(none))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .withColumn("clean_text", F.when(found, clean).otherwise(F.col(text)))
        .drop("lost_lines")
    )

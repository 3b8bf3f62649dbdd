"""Line-first quality rules (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.base import SPACE, word_array

#: Phrases of boilerplate lines, matched in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "subscribe to our newsletter",
    "lorem ipsum",
    "licensed under the",
    "click here",
)
#: Marks between the items of a navigation line; marks that may end a line of prose.
NAVIGATION_MARKS = "|»›•·"
LINE_END = r"[.!?…:;。！？\"'”’»)\]]\s*$"


def line_fails(line: Column, min_marks: int = 3, short_words: int = 3, max_marks_percent: int = 20) -> Column:
    """True for a line with words that a rule removes: punctuation, navigation or boilerplate.

    Punctuation: over ``max_marks_percent`` % of the characters are neither letter, mark, digit nor white space.
    Navigation: ``min_marks`` separator marks or more, or at most ``short_words`` words with no mark that ends a
    line of prose. Boilerplate: a phrase of BOILERPLATE.
    """
    marks = F.regexp_replace(line, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    punctuation = F.length(marks) * 100 > F.length(line) * max_marks_percent
    separators = F.length(marks) - F.length(F.translate(marks, NAVIGATION_MARKS, ""))
    longer = line.rlike(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){" + str(short_words) + r"}[^\x20\x09-\x0D]")
    navigation = (separators >= min_marks) | (~longer & ~line.rlike(LINE_END))
    lowered = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(lowered, F.lit(phrase))
    return punctuation | navigation | boilerplate


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the array ``words``, the first time included.

    Windows are sorted by a 64-bit hash of their words and by place within the row; neighbours of one hash count as
    the same words. Two different windows of a text of n words share a hash with odds of about n^2 / 2^65.
    """
    n = F.size(words)
    at = lambda i: F.get(words, i)
    windows = F.when(
        n >= 4,
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))),
    ).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))

    def covered(sorted_windows: Column) -> Column:
        beside = lambda w, k: F.coalesce(F.get(sorted_windows, k)["h"] == w["h"], F.lit(False))
        hits = F.filter(sorted_windows, lambda w, k: beside(w, k - 1) | beside(w, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))

    # a one-element array binds the sorted windows to a name, so that they are made once a row
    return F.get(F.transform(F.array(windows), covered), F.lit(0)).cast("long")


def quality(docs: DataFrame, max_loss_percent: int = 50, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, clean_text and kept.

    Lines are judged first: a line with words that fails a rule is removed. A document is kept if it passes the
    base conditions (``min_words`` words or more, at most ``max_repeat_percent`` % of the words in repeated
    three-word windows) and its removed lines hold at most ``max_loss_percent`` % of its words.

    A null text counts as empty: no words, so base_failed is true and kept false; clean_text stays null. Columns
    of ``docs`` named like the results are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    words_in = lambda x: F.size(F.filter(F.split(x, SPACE), lambda w: w != ""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "clean_text", "kept")
    lines = F.split(text, "\n")
    judged = (
        docs.drop(*(c for c in names if c in docs.columns))
        .withColumn("_q_words", word_array(F.col("text")))
        .withColumn("_q_lines", F.transform(lines, lambda x: F.struct(x.alias("line"), (has_word(x) & line_fails(x)).alias("fails"))))
        .withColumn("n_words", F.size("_q_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_q_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size(F.filter(lines, has_word)) - F.size(F.array_distinct(F.filter(lines, has_word)))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_q_words")))
        .withColumn("lost_words", F.aggregate("_q_lines", F.lit(0), lambda n, x: n + F.when(x["fails"], words_in(x["line"])).otherwise(0)).cast("long"))
        .withColumn("clean_text", F.when(F.col("text").isNotNull(), F.array_join(F.transform(F.filter("_q_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_words") <= max_loss_percent * F.col("n_words"))).drop("_q_words", "_q_lines")

"""Quality rules: a threshold table compiled into one projection of text ratios.

Native: every measure is a DataFrame expression of the row, so the whole operator is one
scan with one projection; nothing is shuffled, and a row of any length is measured whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import WORD_CLASS, let, words_of

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are as with be this by from or have an at not which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an wird",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
SYMBOLS = "#*$%&|<>"

# measure, comparison, numerator limit, denominator measure, denominator factor:
# a text fails when  factor * measure  <comparison>  limit * denominator.
THRESHOLDS = (
    ("n_symbols", ">", 10, "n_words", 100),        # symbols: over 10 per 100 words
    ("word_chars", "<", 2, "n_words", 1),          # mean word length under 2
    ("word_chars", ">", 16, "n_words", 1),         # mean word length over 16
    ("n_stop_words", "<", 4, "n_words", 100),      # stop words: under 4 per 100 words
    ("n_dup_lines", ">", 50, "n_lines", 100),      # repeated lines: over half
    ("n_bullet_lines", ">", 90, "n_lines", 100),   # lines that start with a list mark
    ("n_ellipsis_lines", ">", 30, "n_lines", 100),  # lines that end in an ellipsis
    ("n_upper_words", ">", 50, "n_words", 100),    # words in capitals: over half
)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)


def _covered(p: Column) -> Column:
    """Words covered by 5-word windows that start at the sorted places ``p``."""
    return _sum(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))).cast("long")))


def _repeated_places(h: Column) -> Column:
    """Sorted places of the values of ``h`` that occur twice or more: one sort of
    (value, place), so a text of n words costs n log n whatever repeats in it."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        hit = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"]))
        return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))
    return let(pairs, places)


def _n_repeat_words(w: Column) -> Column:
    """Words in 5-word windows found twice or more; windows are hashes of word hashes."""
    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - 5), lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(5)])))
    covered = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                  .otherwise(let(_repeated_places(h), _covered)))
    return F.when(F.size(w) < 6, F.lit(0).cast("long")).otherwise(covered)


BLANKS = " \t\n\x0b\x0c\r"


def measures(text: Column) -> dict[str, Column]:
    """Measures of a text as DataFrame expressions (all long)."""
    t = F.coalesce(text, F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    in_words = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _n_repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words")))
    in_lines = let(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•·]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(F.transform(ls, lambda x: F.rtrim(x, F.lit(BLANKS))), lambda x: x.endswith("...") | x.endswith("…")))
        .cast("long").alias("n_ellipsis_lines")))
    return {
        "in_words": in_words, "in_lines": in_lines,
        "n_symbols": F.regexp_count(t, F.lit("[" + SYMBOLS + "]")).cast("long"),
        # the first capital is tried before the look-behind: other characters cost one test
        "n_upper_words": F.regexp_count(t, F.lit(r"\p{Lu}(?<![^\x20\x09-\x0D].)\p{Lu}+(?=\P{L}*(?:[\x20\x09-\x0D]|$))")).cast("long"),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
            "n_bullet_lines", "n_ellipsis_lines", "n_upper_words")


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """True where any row of the threshold table fails; integer arithmetic only."""
    tests = []
    for name, op, limit, per, factor in thresholds:
        left, right = F.lit(factor) * F.col(name), F.lit(limit) * F.col(per)
        tests.append(left > right if op == ">" else left < right)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Per row: id, the measures, ``base_failed``, ``rules_failed`` and ``kept``.

    Base: fewer than 10 words, or over 20 of 100 words lie in 5-word windows that the text
    holds twice or more (windows are compared by their 64-bit hash, within one text).
    Null and empty texts have no word: base_failed.  Repeated rows and null ids give a row
    each; other columns of ``docs`` are not read.
    """
    out = docs.select(F.col(id_col), *[c.alias(n) for n, c in measures(F.col(text_col)).items()])
    out = out.select(F.col(id_col), "n_symbols", "n_upper_words", "in_words.*", "in_lines.*")
    base = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    bad = compile_rules(thresholds)
    return out.select(F.col(id_col), *MEASURES, base.alias("base_failed"), bad.alias("rules_failed"),
                      (~base & ~bad).alias("kept"))

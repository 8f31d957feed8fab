"""Rule-based quality filter: a table of thresholds compiled into one Spark projection.

No user function runs: every ratio is built from string and array functions, so rules ride along with the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import word_array

#: Frequent function words of the languages expected; a text of prose has some.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "an au de des du elle en est et il la le les par pour que qui sur un une "
    "auf das dem den der die ein eine für in ist mit nicht sich und von zu "
    "al con de del el en es la las lo los para por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """``kept`` needs numerator / denominator within [low, high]; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float = float("-inf")
    high: float = float("inf")


#: The method's own rules, beside the two base ones.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2, 12),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that rules refer to. Null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS.split()))])
    out = docs.withColumn("__words", word_array(F.col(text)))
    words = F.col("__words")
    n = F.size(words)
    out = out.withColumn("n_words", n.cast("long"))
    # windows of three words, sorted so that equal ones are neighbours
    out = out.withColumn(
        "__windows",
        F.when(
            n >= 3,
            F.array_sort(
                F.transform(
                    F.sequence(F.lit(1), n - 2),
                    lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")),
                )
            ),
        ),
    )
    w = F.col("__windows")
    found_again = F.filter(w, lambda x, k: (x["h"] == F.get(w, k - 1)["h"]) | (x["h"] == F.get(w, k + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(found_again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))
    return (
        out.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("word_chars", F.char_length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(body) - F.char_length(F.translate(body, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_stop_words", F.size(F.filter(words, lambda x: F.array_contains(stop, F.lower(x)))).cast("long"))
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean: no rule is broken."""
    verdict = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator), F.col(r.denominator)
        if r.low != float("-inf"):
            verdict = verdict & (top >= F.lit(r.low) * bottom)
        if r.high != float("inf"):
            verdict = verdict & (top <= F.lit(r.high) * bottom)
    return verdict


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``.

    Rows are judged one by one: repeated rows and null ids stay as they are; a null or empty text has no words
    and fails. Columns of ``docs`` that have an output's name are replaced.
    """
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept"]
    out = measures(docs.drop(*[c for c in named if c != text]), text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules)).drop("__words", "__windows", "__lines")

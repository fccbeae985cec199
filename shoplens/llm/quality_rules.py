"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

The measures of a text (lengths, symbols, stop words, repeated lines and words) are Spark expressions over
its words; each rule of the table becomes one comparison, and all of them stand in one projection. No
user-defined function, no shuffle: a text is read once, whole, in the task that scans it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.shared import BLANKS, GAP, unused_prefix, whole_text

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple("""
a an and are as at be by for from has he in is it of on or that the this to was with
als auf das dem den der des die ein eine er im in ist mit nicht sich und von zu für über
au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une
al como con de del el en es esta la las lo los no para por que se su un una y
""".split())


@dataclass(frozen=True)
class Rule:
    """A text breaks the rule if the measure is below low or above high; texts of fewer words than min_words pass."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 1


#: The default thresholds.
RULES = (
    Rule("long_enough", "n_words", low=10, min_words=0),
    Rule("word_length", "mean_word_length", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_word_ratio", low=0.02, min_words=40),
    Rule("repeated_words", "repeat_word_ratio", high=0.2),
    Rule("words_in_a_row", "again_ratio", high=0.3),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("list_lines", "bullet_line_ratio", high=0.9, min_words=40),
)

#: Words in a window whose repetition counts.
WINDOW = 5


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def _windows(hashes: str, width: int) -> Column:
    """A hash per place of the words from there on; the last places, with fewer words, are cut off."""
    def at(x, i):
        return F.xxhash64(x, *[F.get(F.col(hashes), i + k) for k in range(1, width)])
    return F.slice(F.transform(F.col(hashes), at), F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))


def measured(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with the measures the rules name (columns of these names are replaced).

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines (lines with a word equal to an earlier
    line), n_repeat_words (words inside windows of five words that occur twice or more in the text),
    n_stop_words, n_again_words (equal to the word before), n_bullet_lines. A null text has no words; ratios over nothing are 0.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
              "n_again_words", "n_bullet_lines"]
    forms = [w for s in STOP_WORDS for w in (s, s.capitalize())]
    plain = docs.drop(*counts)
    own = unused_prefix(plain)
    df = plain.withColumn(f"{own}text", whole_text(text_col))
    df = (df.withColumn(f"{own}words", _words(F.col(f"{own}text")))
          .withColumn(f"{own}lines", F.filter(F.split(f"{own}text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
          .withColumn("n_symbols", (F.length(f"{own}text") - F.length(F.regexp_replace(f"{own}text", "[#*$%&|<>]", "")))
                      .cast("long")))
    df = (df.withColumn(f"{own}hashes", F.transform(f"{own}words", lambda w: F.xxhash64(w)))
          .withColumn("n_words", F.size(f"{own}words").cast("long"))
          .withColumn("word_chars", F.length(F.array_join(f"{own}words", "")).cast("long"))
          .withColumn("n_lines", F.size(f"{own}lines").cast("long"))
          .withColumn("n_dup_lines", (F.size(f"{own}lines") - F.size(F.array_distinct(f"{own}lines"))).cast("long"))
          .withColumn("n_bullet_lines", F.size(F.filter(f"{own}lines", lambda x: F.ltrim(x).rlike("^[-*•·]"))).cast("long"))
          .withColumn("n_again_words", F.size(F.filter(f"{own}words", lambda w, i: F.get(F.col(f"{own}words"), i - 1) == w)).cast("long"))
          .withColumn("n_stop_words", F.size(F.filter(f"{own}words", lambda w: w.isin(forms))).cast("long")))
    df = df.withColumn(f"{own}windows", _windows(f"{own}hashes", window))
    # Equal windows have equal hashes: where all hashes differ nothing repeats. Elsewhere the words themselves decide.
    spelled = F.transform(f"{own}words", lambda w, i: F.struct(
        F.array_join(F.slice(F.col(f"{own}words"), i + 1, F.lit(window)), " ").alias("said"), i.alias("at")))
    df = df.withColumn(f"{own}sorted", F.when(
        F.size(F.array_distinct(f"{own}windows")) < F.size(f"{own}windows"),
        F.array_sort(F.slice(spelled, F.lit(1), F.size(f"{own}windows")))))
    def twin(x, k):
        return (F.get(F.col(f"{own}sorted"), k - 1)["said"] == x["said"]) | (F.get(F.col(f"{own}sorted"), k + 1)["said"] == x["said"])
    places = F.array_sort(F.filter(
        F.transform(f"{own}sorted", lambda x, k: F.when(F.coalesce(twin(x, k), F.lit(False)), x["at"])), F.isnotnull))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda seen, at: F.struct((at + window).alias("end"),
                                  (seen["n"] + window - F.greatest(seen["end"] - at, F.lit(0))).alias("n")))["n"]
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.select(*plain.columns, *counts)


def _measure(name: str) -> Column:
    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return {
        "n_words": F.col("n_words"), "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"), "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "again_ratio": ratio("n_again_words", "n_words"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
    }[name]


def compiled(rules: Sequence[Rule]) -> Column:
    """Names of the broken rules, in the table's order."""
    def broken(rule: Rule) -> Column:
        value, bad = _measure(rule.measure), F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        return F.when((F.col("n_words") >= rule.min_words) & bad, F.lit(rule.name))
    return F.array_compact(F.array(*[broken(r) for r in rules]))


def judged(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with their measures, the broken rules and kept (no rule is broken).

    Columns of the added names are replaced. A null or empty text has 0 words and breaks long_enough. Repeated rows
    are judged each for itself; an empty table stays empty.
    """
    df = measured(docs, text_col).withColumn("broken_rules", compiled(rules))
    return df.withColumn("kept", F.size("broken_rules") == 0)

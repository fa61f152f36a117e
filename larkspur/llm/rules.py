"""Quality rules (8): a threshold table compiled into one projection, without user functions.

`RULES` names each measured ratio and the range in which it must lie. `judge` turns the table into
columns of a single Spark projection: no shuffle, no join, no Python on the executors, so the work is
one scan and grows with the bytes read. Nulls and empty texts have no words and fail the base rule;
very long texts cost n log n in their own row; copies are judged alike; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, documents, texts, words

# Frequent function words of the languages at hand.
STOP_WORDS = "a and in is of on the to das der die ein ist und von de el la los que y des est et le les un une".split()

SYMBOLS = "#*$%&|<>"

#: measure, least, most; a document is kept if the base rule passes and every measure lies in its range.
RULES: tuple[tuple[str, float, float], ...] = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", 0.0, 0.3),
    ("dup_line_share", 0.0, 0.3),
    ("stop_word_share", 0.02, 1.0),
    ("upper_share", 0.0, 0.6),
)


def _repeat_words(w: str) -> str:
    """SQL for the words of `w` inside 3-word windows that the text holds twice or more.

    Windows are compared as whole word triples. Sorting (window, place) pairs brings equal windows
    together; the places of those are sorted again and each adds the words that the last left uncovered.
    """
    pairs = f"array_sort(transform(sequence(0, size({w}) - 3), i -> struct(xxhash64({w}[i], {w}[i+1], {w}[i+2]) AS h, i AS p)))"
    # The sort is by a 64-bit hash; neighbours count as equal only if their words are.
    same = lambda a, b: f"({a}.h = {b}.h AND {w}[{a}.p] = {w}[{b}.p] AND {w}[{a}.p+1] = {w}[{b}.p+1] AND {w}[{a}.p+2] = {w}[{b}.p+2])"
    repeated = f"transform(transform(array({pairs}), s -> filter(s, (x, i) -> (i > 0 AND {same('x', 's[i-1]')}) OR (i < size(s) - 1 AND {same('x', 's[i+1]')})))[0], x -> x.p)"
    covered = f"aggregate(array_sort({repeated}), struct(0 AS n, -3 AS at), (a, p) -> struct(a.n + least(3, p - a.at) AS n, p AS at), a -> a.n)"
    return f"CASE WHEN size({w}) < 4 THEN 0 ELSE {covered} END"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the counts that the rules are stated in."""
    t = F.col("text")
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    base = texts(docs).withColumn("w", words(t)).withColumn("lines", lines)
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("w")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.size(F.split(F.concat(F.lit(" "), F.lower(t), F.lit(" ")), r"(?<=[\x20\x09-\x0D])(?:" + "|".join(STOP_WORDS) + r")(?=[\x20\x09-\x0D])")).cast("long").alias("n_stop"),
    ).withColumn("n_stop", F.col("n_stop") - 1)


def ratios() -> dict[str, Column]:
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_word_chars": F.col("word_chars") / w,
        "symbols_per_word": F.col("n_symbols") / w,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "stop_word_share": F.col("n_stop") / w,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
    }


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts, ratios, base_failed and kept for every document."""
    of = ratios()
    m = measures(docs).withColumns(of)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    held = F.lit(True)
    for name, least, most in rules:
        held = held & F.col(name).between(least, most)
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & held)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

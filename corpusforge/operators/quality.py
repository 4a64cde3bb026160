"""Gates that give a reason for each rejected row, and the turn-order linter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.functions import answers as A
from corpusforge.functions.text import text, trim, word_count
from corpusforge.operators.shape import canonical_role

#: Fixed values, in the order in which a partly matching type is resolved.
TYPES = ("conceptual", "numerical", "derivation", "comparative", "application", "misconception", "multi_step", "true_false")
DIFFICULTIES = ("school", "bsc_early", "bsc_advanced", "msc")
QUESTION_WORDS, ANSWER_WORDS = 8, (20, 1500)


def resolved_type(kind: Column) -> Column:
    """The type itself, or the first known one that contains it or is contained in it; or null."""
    low = F.lower(trim(text(kind)))
    partly = F.get(F.filter(F.array(*map(F.lit, TYPES)), lambda t: low.contains(t) | t.contains(low)), F.lit(0))
    return F.when(low.isin(*TYPES), low).otherwise(partly)


def resolved_difficulty(difficulty: Column) -> Column:
    low = F.lower(trim(text(difficulty)))
    return F.when(low.isin(*DIFFICULTIES), low).otherwise("bsc_early")


def format_reason(question: Column, answer: Column, kind: Column) -> Column:
    """Why the format gate rejects a row, or null."""
    return (
        F.when(text(question) == "", "missing field: question")
        .when(text(answer) == "", "missing field: answer")
        .when(text(kind) == "", "missing field: type")
        .when(resolved_type(kind).isNull(), F.concat(F.lit("invalid type: "), F.lower(trim(text(kind)))))
    )


def length_reason(question: Column, answer: Column) -> Column:
    """Why the length gate rejects a row, or null."""
    q, a, (low, high) = word_count(question), word_count(answer), ANSWER_WORDS
    return (
        F.when(q < QUESTION_WORDS, F.concat(F.lit("question too short: "), q, F.lit(f" words (min {QUESTION_WORDS})")))
        .when(a < low, F.concat(F.lit("answer too short: "), a, F.lit(f" words (min {low})")))
        .when(a > high, F.concat(F.lit("answer too long: "), a, F.lit(f" words (max {high})")))
    )


def word_gate(t: Column, low: int, high: int) -> Column:
    """Why a text is outside a range of word counts, or null."""
    n = word_count(t)
    return F.when(n == 0, "empty").when(n < low, "too_short").when(n > high, "too_long")


def turn_issues(turns: DataFrame, conv: str, order: str, role: str) -> DataFrame:
    """``(conv, issue)`` of every conversation: valid, empty, starts_with_X or the first consecutive_X, system turns aside."""
    rows = turns.select(conv, F.col(order).alias("n"), canonical_role(F.col(role)).alias("r"))
    spoken = rows.filter("r is null or r <> 'system'").withColumn("r", text("r"))
    line = W.partitionBy(conv).orderBy("n")
    marked = spoken.withColumn("before", F.lag("r").over(line)).withColumn("k", F.row_number().over(line))
    issue = F.when((F.col("k") == 1) & (F.col("r") != "user"), F.concat(F.lit("starts_with_"), "r")).when(F.col("r") == F.col("before"), F.concat(F.lit("consecutive_"), "r"))
    first = marked.withColumn("issue", issue).groupBy(conv).agg(F.min_by("issue", F.when(F.col("issue").isNotNull(), F.col("k"))).alias("issue"), F.lit(True).alias("spoken"))
    every = rows.select(conv).distinct()
    return every.join(first, conv, "left").select(conv, F.when(F.col("spoken").isNull(), "empty").otherwise(F.coalesce("issue", F.lit("valid"))).alias("issue"))


def issue_breakdown(issues: DataFrame) -> DataFrame:
    """``(issue, n, pct, ok)`` of the issues of conversations; no rows without any."""
    counted = issues.groupBy("issue").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))), 2)
    return counted.select("issue", "n", share.alias("pct"), (F.col("issue") == "valid").alias("ok"))


def consistency(df: DataFrame) -> DataFrame:
    """Rows (answer, solution, answer_type) with ``status``: no_solution, no_answer, matched or mismatched. Blank counts as none."""
    ok = A.consistent(F.col("answer"), F.col("solution"), F.col("answer_type"))
    none = lambda c: trim(text(c)) == ""
    return df.withColumn("status", F.when(none("solution"), "no_solution").when(none("answer"), "no_answer").when(ok, "matched").otherwise("mismatched"))

"""Benchmarks as tasks: how a record becomes a sample, and where its records are found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.arithmetic import equation_value
from corpusforge.functions.text import text, trim
from corpusforge.operators import shape
from corpusforge.sources.files import resolve

# Fixed values of this module: domains, categories and prompt texts of the benchmarks.
STEM_DOMAIN = "Science"
STEM_CATEGORIES = ("गणित", "भौतिकी", "रसायन विज्ञान", "जीव विज्ञान")
NUMBER_ONLY = "\nकृपया केवल संख्यात्मक उत्तर दें। (Please provide only the numerical answer.)"


def or_else(column: Column, other: str) -> Column:
    """The text, or another one for a null or empty text."""
    return F.when(text(column) == "", other).otherwise(column)


def exam_samples(df: DataFrame, exam: str) -> DataFrame:
    """``id, input, target, metadata`` of an exam's records. A subject that lacks is ``unknown``, a type ``single_correct``."""
    kind = F.coalesce("question_type", F.lit("single_correct"))
    low = F.lower(or_else(F.col("subject"), "unknown"))
    about = F.struct(
        F.coalesce("exam", F.lit(exam)).alias("exam"), "year", "paper", low.alias("subject"), kind.alias("question_type"),
        F.coalesce("has_diagram", F.lit(False)).alias("has_diagram"),
    )
    prompt = shape.exam_prompt(F.col("subject"), kind, F.col("question"), F.col("options"))
    return df.select("id", prompt.alias("input"), trim(text("answer")).alias("target"), about.alias("metadata"))


def open_samples(df: DataFrame) -> DataFrame:
    """``input, target`` of open questions (question, type, gold)."""
    prompt = F.concat(text("question"), F.lit("\n\n"), shape.solver_suffix(text("type")), F.lit("\n"))
    return df.select(prompt.alias("input"), trim(text("gold")).alias("target"))


def four_option_samples(df: DataFrame) -> DataFrame:
    """``input, target`` of science questions with four options; an empty option goes together with its letter."""
    options = [F.when(text(f"option{i}") != "", F.concat(F.lit(f"{'ABCD'[i - 1]}) "), f"option{i}")) for i in range(1, 5)]
    prompt = F.concat(text("question"), F.lit("\n\n"), F.concat_ws("\n", *options), F.lit("\n\nAnswer:"))
    return df.filter(F.col("domain") == STEM_DOMAIN).select(prompt.alias("input"), shape.option_key_index(F.col("target")).alias("target"))


def many_option_samples(df: DataFrame) -> DataFrame:
    """``input, choices, target`` of questions with up to ten options, of four categories; other categories and none go."""
    options = F.col("options")
    return df.filter(trim(text("category")).isin(*STEM_CATEGORIES)).select(
        shape.mcq_prompt(F.col("question"), options).alias("input"), shape.surviving_letters(options).alias("choices"),
        shape.target_index(options, F.col("answer"), F.col("answer_index")).alias("target"),
    )


def word_problem_samples(df: DataFrame) -> DataFrame:
    """``input, target`` of word problems; the target is the value of the equation's right side, null if it has none."""
    return df.select(F.concat(text("Problem"), F.lit(NUMBER_ONLY)).alias("input"), equation_value(F.col("Equation")).alias("target"))


def image_samples(df: DataFrame) -> DataFrame:
    """``image, target`` of questions that are images; a JSON list of answers is joined by commas."""
    return df.select("image", shape.json_answer(F.col("correct_answer")).alias("target"))


@dataclass(frozen=True)
class Task:
    """A benchmark: what its records look like, how they become samples, which metrics score them."""

    schema: str
    samples: Callable[[DataFrame], DataFrame]
    metrics: tuple[str, ...]
    shots: int = 0


_EXAM = "id STRING, exam STRING, year INT, paper STRING, subject STRING, question_type STRING, language STRING, question STRING, options ARRAY<STRUCT<label STRING, text STRING>>, answer STRING, has_diagram BOOLEAN"
TASKS = {
    "exam_main": Task(_EXAM, lambda df: exam_samples(df, "jee_main"), ("accuracy", "stderr", "grouped")),
    "exam_advanced": Task(_EXAM, lambda df: exam_samples(df, "jee_advanced"), ("accuracy", "stderr", "grouped")),
    "open": Task("question STRING, type STRING, gold STRING", open_samples, ("open_score",)),
    "four_options": Task("question STRING, option1 STRING, option2 STRING, option3 STRING, option4 STRING, target STRING, domain STRING", four_option_samples, ("acc", "acc_norm")),
    "many_options": Task("question STRING, options ARRAY<STRING>, answer STRING, answer_index INT, category STRING", many_option_samples, ("acc", "acc_norm")),
    "word_problems": Task("Problem STRING, Equation STRING", word_problem_samples, ("absolute",)),
    "images": Task("image BINARY, correct_answer STRING", image_samples, ("exact_match",)),
}


def load(spark: SparkSession, task: str, *candidates: str, examples: DataFrame | None = None) -> DataFrame:
    """Samples of a task from the first of the paths that exists: Parquet, JSON lines, or a JSON array (``.json``).

    A task with shots takes them from ``examples`` (its other split, read as records), in the order of their input.
    """
    t, path = TASKS[task], resolve(spark, *candidates)
    reader = spark.read.schema(t.schema)
    rows = reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.option("multiLine", path.endswith(".json")).json(path)
    found = t.samples(rows)
    return found if examples is None else with_shots(found, t.samples(examples), t.shots, "input")


def with_shots(samples: DataFrame, examples: DataFrame, shots: int, *order: str) -> DataFrame:
    """Samples whose ``input`` has the first ``shots`` examples (input, target) in front, each with its target and a blank line after it."""
    if not shots:
        return samples
    first = examples.orderBy(*order).limit(shots).select(F.struct(*order).alias("at"), F.concat("input", F.lit(" "), F.col("target").cast("string"), F.lit("\n\n")).alias("shown"))
    shown = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), "").alias("__shown"))  # one row
    return samples.crossJoin(F.broadcast(shown)).withColumn("input", F.concat("__shown", "input")).drop("__shown")


def select(names: list[str], only: list[str] | None = None, skip: list[str] | None = None) -> list[str]:
    """The names that are wanted and not skipped, in their order, whatever their case; a name that isn't there is an error."""
    low = {n.lower() for n in names}
    asked, gone = ({x.lower() for x in part or ()} for part in (only, skip))
    if unknown := (asked | gone) - low:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    return [n for n in names if (not asked or n.lower() in asked) and n.lower() not in gone]

"""Solutions that a model writes for exam questions: its prompt, which answers count, the record, the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import letters, text, trim, word_count

# Fixed values of this module: subjects in file names, words a solution needs, the texts of the prompt.
NAMED_SUBJECTS = (("biology", "biology"), ("chemistry", "chemistry"), ("physics", "physics"), ("math", "mathematics"))
MIN_WORDS = 15
DEFAULT_LEVEL = "JEE_Advanced"
DIAGRAM_NOTE = "\n⚠️  This question has an attached diagram not available in text. Solve using the text description alone."
PROMPT_HEAD = "Solve this JEE/NEET question with complete step-by-step reasoning.\n\n"
PROMPT_ANSWER = "\nANSWER: (NOT provided — you must determine it yourself from the question and options)\nDIAGRAM: "
PROMPT_TASK = """

TASK: Produce a complete, rigorous, step-by-step solution in the SAME LANGUAGE as the question above.
Determine the correct answer entirely from your own reasoning. Explain why your chosen answer is correct, and (for MCQ) why each other option is wrong.
Think deeply. Show ALL working. No shortcuts.

ALSO: Populate the "answer" field with the final answer using the STRICT format rules:
  • single-correct MCQ → one capital letter (e.g. "B")
  • multi-correct MCQ → sorted concatenated letters (e.g. "AC", "ABD")
  • numerical / integer → the numeric value as a plain string (e.g. "9.5", "-12")
Set "answer_type" accordingly: "mcq_single", "mcq_multi", or "numerical"."""

GENERATED = "solution STRING, answer STRING, answer_type STRING, subject STRING, topic_tags ARRAY<STRING>, difficulty STRING, requires_diagram BOOLEAN, solution_language STRING"


def file_subject(name: Column) -> Column:
    """The subject that a file's name tells, else ``unknown``."""
    low, found = F.lower(name), F.lit("unknown")
    for part, subject in reversed(NAMED_SUBJECTS):
        found = F.when(low.contains(part), subject).otherwise(found)
    return found


def question_id(name: Column, number: Column) -> Column:
    """Stem of a file name, 60 characters of it, others than letters, digits, _ and - as _, and the question's number."""
    base = F.regexp_extract(F.coalesce(name, F.lit("unknown")), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"(?s)^(.+)\.[^.]+$", "$1")
    return F.concat(F.substring(F.regexp_replace(stem, r"[^a-zA-Z0-9_\-]", "_"), 1, 60), F.lit("_Q"), F.coalesce(number, F.lit("?")))


def solver_prompt(number: Column, subject: Column, section: Column, language: Column, question: Column, options: Column, has_diagram: Column) -> Column:
    """What a solver is asked. The options are numbered from 1; a null counts as ``?``, ``unknown`` or empty."""
    numbered = F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("  ("), (i + 1).cast("string"), F.lit(")  "), text(o))), "\n")
    listed = F.when(F.coalesce(F.size(options), F.lit(0)) > 0, numbered).otherwise("  (no options provided)")
    drawn = F.coalesce(has_diagram, F.lit(False))
    return F.concat(
        F.lit(PROMPT_HEAD), F.lit("QUESTION #"), F.coalesce(number, F.lit("?")), F.lit(" | SUBJECT: "), F.coalesce(subject, F.lit("unknown")),
        F.lit(" | SECTION: "), text(section), F.lit(" | LANGUAGE: "), F.coalesce(language, F.lit("unknown")), F.lit(PROMPT_ANSWER),
        F.when(drawn, "YES (not provided — use text only)").otherwise("NO"), F.lit("\n\n📝 QUESTION:\n"), text(question),
        F.lit("\n\n📋 OPTIONS:\n"), listed, F.lit("\n"), F.when(drawn, DIAGRAM_NOTE).otherwise(""), F.lit(PROMPT_TASK),
    )


def parsed(raw: Column) -> Column:
    """A model's JSON object, with or without a fence around it, as a struct; null if it isn't one."""
    bare = F.regexp_replace(F.regexp_replace(text(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    valid = F.try_parse_json(bare).isNotNull() & bare.rlike(r"^\s*\{")
    return F.when(valid, F.from_json(bare, GENERATED))


def judged(df: DataFrame, raw: str) -> DataFrame:
    """The rows with ``generated`` and ``reason``: null for an answer that counts, else the first rule that it breaks.

    Letters of a choice are put in order, without others and repeats.
    """
    g = F.col("generated")
    choice = F.lower(trim(text(g["answer_type"]))).isin("mcq_single", "mcq_multi")
    answer = F.when(choice, letters(trim(text(g["answer"])))).otherwise(trim(text(g["answer"])))
    reason = (
        F.when(g.isNull(), "not_json").when(text(g["solution"]) == "", "no_solution")
        .when(trim(text(g["answer"])) == "", "no_answer").when(word_count(g["solution"]) < MIN_WORDS, "too_short")
    )
    read = df.withColumn("generated", parsed(F.col(raw)))
    return read.withColumn("reason", reason).withColumn("generated", F.when(g.isNotNull(), g.withField("answer", answer)))


def records(accepted: DataFrame) -> DataFrame:
    """Records of accepted answers. The generated subject wins over the question's; the question's own answer is left out."""
    g = F.col("generated")
    subject = F.when(text(g["subject"]) != "", g["subject"]).otherwise(F.coalesce("subject", F.lit("unknown")))
    level = F.coalesce("level", F.lit(DEFAULT_LEVEL))
    return accepted.select(
        text("question").alias("question"), F.coalesce("options", F.array().cast("array<string>")).alias("options"), g["answer"].alias("answer"),
        F.coalesce(g["answer_type"], F.lit("mcq_single")).alias("answer_type"), g["solution"].alias("solution"), subject.alias("subject"), level.alias("level"),
        F.concat(subject, F.lit("_"), level).alias("group"), F.coalesce("question_no", F.lit("?")).alias("chunk_id"), text("source_file").alias("source_chunks_file"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row: ``total, generated, failed, success_rate`` (percent, one place; 0 without rows)."""
    n, ok = F.count("*"), F.count_if(F.col("reason").isNull())
    return rows.agg(n.alias("total"), ok.alias("generated"), (n - ok).alias("failed"), F.round(ok / F.greatest(n, F.lit(1)) * 100, 1).alias("success_rate"))


def distributions(df: DataFrame, *columns: str) -> DataFrame:
    """``(cut, value, n)``: how often each value of each column occurs, all columns in one pass; null is a value."""
    cuts = F.array(*(F.struct(F.lit(c).alias("cut"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(cuts).alias("c")).groupBy("c.cut", "c.value").agg(F.count("*").alias("n"))

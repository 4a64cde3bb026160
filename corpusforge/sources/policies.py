"""What each kind of source has to offer to be kept, and how its rows become conversations.

Every policy turns a table into ``prio, ord, reason, question, answer, conversations,
metadata``. ``reason`` is null for rows that are kept, else the first rule that failed.
Duplicates are a later, global step: :func:`corpus`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import hash_normal, text, word_count
from corpusforge.operators import shape
from corpusforge.operators.quality import word_gate
from corpusforge.sources.files import first_column

# Column names by which a question-answer table is recognised, in order.
QUESTION = ("question", "Question", "input", "instruction", "prompt", "text")
ANSWER = ("answer", "Answer", "output", "response", "target", "completion")
SUBJECT = ("subject", "Subject", "category", "topic")
GRADE = ("grade", "Grade", "class", "Class")


@dataclass
class Parts:
    """Question and answer, the rules beyond them, and optionally turns and metadata."""

    question: Column
    answer: Column
    reason: Column
    metadata: dict[str, Column]
    turns: Column | None = None


def _is_blank(*columns: Column) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | (text(c) == "")
    return found


def _unless(condition: Column, reason: str) -> Column:
    """The reason, unless the condition is known to hold."""
    return F.when(~F.coalesce(condition, F.lit(False)), reason)


def math_cot(df: DataFrame) -> Parts:
    solution = df["generated_solution"]
    reason = F.coalesce(_unless(df["problem_type"] == "has_answer_extracted", "no_answer"), word_gate(solution, 50, 3000))
    return Parts(df["problem"], solution, reason, {"problem_source": F.coalesce(df["problem_source"], F.lit("unknown"))})


def math_reasoning(df: DataFrame) -> Parts:
    reason = F.coalesce(_unless(df["correctness_count"] >= 1, "not_verified"), word_gate(df["solution"], 50, 3000))
    return Parts(df["problem"], df["solution"], reason, {})


def math_messages(df: DataFrame) -> Parts:
    solution = shape.last_assistant(df["messages"])
    return Parts(df["problem"], solution, word_gate(solution, 50, 2500), {"data_source": df["data_source"], "tool_usage": df["tool_usage"]})


def thoughts(df: DataFrame) -> Parts:
    turns, domain = df["conversations"], F.lower(text(df["domain"]))
    asked, said = shape.first_turn(turns, "human", True), shape.first_turn(turns, "gpt", True)
    reason = F.coalesce(F.when(domain.contains("code"), "code"), _unless(F.size(turns) >= 2, "too_few_turns"), word_gate(said, 50, 5000))
    return Parts(asked, said, reason, {"domain": domain}, turns)


def science_messages(df: DataFrame) -> Parts:
    turns = shape.from_messages(df["messages"])
    asked, said = shape.first_turn(turns, "human"), shape.first_turn(turns, "gpt")
    reason = F.coalesce(_unless(F.size(df["messages"]) >= 2, "too_few_turns"), _unless(word_count(said) >= 20, "too_short"))
    return Parts(asked, said, reason, {"split": F.lower(text(df["split"])), "used_in": df["used_in"]}, turns)


def mcq_image(df: DataFrame) -> Parts:
    choices, at = df["choices"], df["answer"]
    listed = F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(") "), text(c))), "\n")
    more = F.when(_is_blank(df["solution"]), "").otherwise(F.concat(F.lit("\n\nExplanation: "), df["solution"]))
    right = F.get(choices, F.when(at >= 0, at))
    answer = F.concat(F.lit("The correct answer is: "), text(right), F.lit("\n\n"), text(df["lecture"]), more)
    reason = F.coalesce(
        F.when(df["image"].isNotNull(), "image"),
        F.when(_is_blank(df["question"], df["lecture"]), "missing"),
        _unless((at >= 0) & (at < F.size(choices)), "no_such_choice"),
        _unless(word_count(answer) >= 30, "too_short"),
    )
    return Parts(F.concat(text(df["question"]), F.lit("\n\n"), listed), answer, reason, {})


def sciq(df: DataFrame) -> Parts:
    answer = F.concat(df["correct_answer"], F.lit("\n\nExplanation: "), text(df["support"]))
    reason = F.coalesce(F.when(_is_blank(df["correct_answer"]), "missing"), _unless(word_count(df["support"]) >= 10, "no_explanation"))
    return Parts(df["question"], answer, reason, {})


def school(df: DataFrame) -> Parts:
    """Rows out of subject or grade don't stand in the way of later ones: they are rejected before duplicates are looked for."""
    asked, said = first_column(df, QUESTION, True), first_column(df, ANSWER, True)
    grade = first_column(df, GRADE).cast("string")
    subject = shape.subject(F.coalesce(first_column(df, SUBJECT), F.lit("general")))
    reason = F.coalesce(_unless(word_count(said) >= 10, "too_short"), _unless(shape.grade_allowed(subject, grade), "out_of_grade"))
    return Parts(asked, said, reason, {"subject": subject, "grade": grade})


def synthetic(df: DataFrame) -> Parts:
    """Conversations of two turns or more, or rows of instruction and output."""
    turns = F.when(F.size("conversations") >= 2, df["conversations"])
    talks = df["conversations"].isNotNull()
    asked = F.when(talks, shape.first_turn(turns, "human")).otherwise(df["instruction"])
    said = F.when(talks, shape.first_turn(turns, "gpt")).otherwise(df["output"])
    reason = F.when(talks & turns.isNull(), "too_few_turns").when(~talks & _is_blank(said), "missing")
    return Parts(asked, said, reason, {}, F.coalesce(turns, shape.conversation(asked, said)))


#: In the order in which a question that several sources have is kept.
POLICIES: dict[str, Callable[[DataFrame], Parts]] = {
    f.__name__: f for f in (math_cot, math_reasoning, math_messages, thoughts, science_messages, mcq_image, sciq, school, synthetic)
}
_ANSWER_MAY_LACK = {"synthetic"}


def judged(df: DataFrame, policy: str, order: str) -> DataFrame:
    """All rows of a source by its policy. Null and empty texts are both missing; ``order`` is a column of whole numbers."""
    p = POLICIES[policy](df)
    missing = _is_blank(p.question) if policy in _ANSWER_MAY_LACK else _is_blank(p.question, p.answer)
    with_source = {"source": F.lit(policy), **p.metadata}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in with_source.items()]), lambda e: e["v"].isNotNull())
    turns = p.turns if p.turns is not None else shape.conversation(p.question, p.answer)
    return df.select(
        F.lit(list(POLICIES).index(policy)).alias("prio"), df[order].cast("long").alias("ord"),
        F.coalesce(F.when(missing, "missing"), p.reason).alias("reason"),
        p.question.alias("question"), p.answer.alias("answer"), turns.alias("conversations"), F.map_from_entries(pairs).alias("metadata"),
    )


def corpus(sources: dict[str, DataFrame], order: str = "ord") -> DataFrame:
    """Kept rows of all sources; of equal questions the one of the first source, then of the smallest order.

    Repeated rows leave one. Rows are reduced before the shuffle, so a hot question isn't gathered.
    """
    if not sources:
        raise ValueError("no sources")
    kept = None
    for policy, df in sources.items():
        rows = judged(df, policy, order).filter("reason is null").drop("reason")
        kept = rows if kept is None else kept.unionByName(rows)
    first = F.min_by(F.struct(*kept.columns), F.struct("prio", "ord", F.xxhash64("question", "answer"))).alias("row")
    return kept.groupBy(F.sha2(hash_normal(F.col("question")), 256)).agg(first).select("row.*")


def reused(rows: DataFrame) -> DataFrame:
    """Rows that an earlier run kept, with ``question`` (the first human turn with a text) and ``reason``.

    Fewer than two turns are ``malformed``, turns without a human text ``no_question``; all others are taken as they are.
    """
    turns = F.col("conversations")
    question = F.get(F.filter(turns, lambda t: (t["from"] == "human") & (text(t["value"]) != "")), F.lit(0))["value"]
    reason = F.when(turns.isNull() | (F.size(turns) < 2), "malformed").when(question.isNull(), "no_question")
    return rows.withColumn("question", question).withColumn("reason", reason)


def with_reused(rows: DataFrame, anchored: str = "anchored") -> DataFrame:
    """Of (prio, ord, question, anchored): all anchored rows, and the others that are the first of their question.

    An anchored row isn't tested itself, but later rows with its question go. Repeated places of equal questions leave one row.
    """
    first = F.min_by(F.struct(*rows.columns), F.struct("prio", "ord")).alias("row")
    tested = rows.groupBy(F.sha2(hash_normal(F.col("question")), 256)).agg(first).select("row.*").filter(~F.col(anchored))
    return rows.filter(anchored).unionByName(tested)

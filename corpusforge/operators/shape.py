"""Conversations, question-answer records, exam rows and prompts, as projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import text, trim

# Fixed values of this module: role names, letters, aliases, sections and prompt texts.
USER_ROLES, ASSISTANT_ROLES = ("user", "human"), ("assistant", "gpt", "model")


def turn(who: str, value: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), value.alias("value"))


def conversation(question: Column, answer: Column, system: Column | None = None) -> Column:
    """Turns of a question and its answer, after a system turn if one is given."""
    turns = F.array(turn("human", question), turn("gpt", answer))
    return turns if system is None else F.concat(F.array(turn("system", system)), turns)


def record(df: DataFrame, system: Column | None = None) -> DataFrame:
    """``conversations, metadata`` of question-answer rows. A column that the table lacks, or a null in it, is ``unknown``
    (no key concepts: none); the chunk's own id stands in for that of its source."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    known = {"source": have("book_title"), "source_chunk_id": F.coalesce(have("source_chunk_id"), have("chunk_id"))}
    known |= {c: have(c) for c in ("subject", "topic", "type", "difficulty", "level")}
    concepts = F.coalesce("key_concepts", F.array().cast("array<string>")) if "key_concepts" in df.columns else F.array().cast("array<string>")
    about = F.struct(*[F.coalesce(v.cast("string"), F.lit("unknown")).alias(k) for k, v in known.items()], concepts.alias("key_concepts"))
    return df.select(conversation(F.col("question"), F.col("answer"), system).alias("conversations"), about.alias("metadata"))


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written: what comes first of all, and before and after each role's text. A role that isn't named is written as ``other``."""

    begin: str
    roles: dict[str, tuple[str, str]]
    other: tuple[str, str] = ("", "\n")


#: The turn marks of an open model family.
TURN_MARKS = ChatTemplate(
    "<bos>", {r: (f"<start_of_turn>{r}\n", "<end_of_turn>\n") for r in ("system", "user")} | {"assistant": ("<start_of_turn>model\n", "<end_of_turn>\n")}
)


def rendered(turns: Column, template: ChatTemplate = TURN_MARKS) -> Column:
    """Turns as one training text, without the mark of the beginning, which the tokenizer puts in front itself."""

    def one(t: Column) -> Column:
        role, (before, after) = canonical_role(t["from"]), template.other
        out = F.concat(F.lit(before), trim(text(t["value"])), F.lit(after))
        for name, (before, after) in template.roles.items():
            out = F.when(role == name, F.concat(F.lit(before), trim(text(t["value"])), F.lit(after))).otherwise(out)
        return out

    whole = F.concat(F.lit(template.begin), F.array_join(F.transform(turns, one), ""))
    return F.when(whole.startswith(template.begin), F.substring(whole, F.lit(len(template.begin) + 1), F.char_length(whole))).otherwise(whole)


def canonical_role(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin(*USER_ROLES), "user").when(low.isin(*ASSISTANT_ROLES), "assistant").otherwise(low)


def from_messages(messages: Column) -> Column:
    """Human and gpt turns of (role, content) messages; other roles and empty ones go."""
    kept = F.filter(messages, lambda m: canonical_role(m["role"]).isin("user", "assistant") & (trim(text(m["content"])) != ""))
    return F.transform(kept, lambda m: F.struct(F.when(canonical_role(m["role"]) == "user", "human").otherwise("gpt").alias("from"), m["content"].alias("value")))


def joined_parts(parts: Column) -> Column:
    """One text of a message's (type, text) parts, in order; parts without a text, such as images, go. Null for null parts."""
    return F.array_join(F.transform(parts, lambda p: text(p["text"])), "")


def first_turn(turns: Column, who: str, non_empty: bool = False) -> Column:
    """Value of the first turn of human or gpt; empty if there is none."""
    role = "user" if who == "human" else "assistant"
    keep = F.filter(turns, lambda t: (canonical_role(t["from"]) == role) & (F.lit(not non_empty) | (text(t["value"]) != "")))
    return text(F.get(keep, F.lit(0))["value"])


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant message that isn't empty, or null."""
    kept = F.filter(messages, lambda m: (canonical_role(m["role"]) == "assistant") & (text(m["content"]) != ""))
    return F.try_element_at(kept, F.lit(-1))["content"]


def gather_turns(turns: DataFrame, conv: str, order: str, role: str, content: str) -> DataFrame:
    """One row a conversation with its messages in order."""
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("m"))
    return rows.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def lettered(options: Column, letters: str = "ABCDEFGHIJ", bracket: str = ") ", drop_blank: bool = True) -> Column:
    """``A) option`` lines. Blank options go together with their letter."""
    numbered = F.transform(F.slice(options, 1, len(letters)), lambda o, i: F.when(F.lit(not drop_blank) | (trim(text(o)) != ""), F.concat(F.substring(F.lit(letters), i + 1, F.lit(1)), F.lit(bracket), trim(text(o)))))
    return F.array_join(F.filter(numbered, lambda x: x.isNotNull()), "\n")


def mcq_prompt(question: Column, options: Column) -> Column:
    return F.concat(trim(text(question)), F.lit("\n\n"), lettered(options), F.lit("\n\nAnswer:"))


def surviving_letters(options: Column, letters: str = "ABCDEFGHIJ") -> Column:
    numbered = F.transform(F.slice(options, 1, len(letters)), lambda o, i: F.when(trim(text(o)) != "", F.substring(F.lit(letters), i + 1, F.lit(1))))
    return F.filter(numbered, lambda x: x.isNotNull())


def target_index(options: Column, answer: Column, fallback: Column) -> Column:
    """Place of the answer's letter among the letters of options that aren't blank, else the fallback."""
    at = F.array_position(surviving_letters(options), F.upper(trim(text(answer))))
    return F.when(at > 0, at - 1).otherwise(fallback).cast("int")


def option_key_index(target: Column) -> Column:
    """option1 to option4 as 0 to 3, else 0."""
    return F.coalesce(F.regexp_extract(target, "^option([1-4])$", 1).try_cast("int") - 1, F.lit(0))


SUBJECT_ALIASES = {"math": "mathematics", "maths": "mathematics", "bio": "biology", "chem": "chemistry", "phy": "physics"}
SUBJECT_SHORT = {"mathematics": "math", "physics": "phys", "chemistry": "chem", "biology": "bio"}
SECTION = {"single_correct": "A", "multi_correct": "A", "numerical": "B"}


def _looked_up(column: Column, known: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[column], default)


def subject(s: Column) -> Column:
    low = F.lower(trim(text(s)))
    return _looked_up(low, SUBJECT_ALIASES, low)


def grade_allowed(subject_: Column, grade: Column) -> Column:
    """Science of grades 6 to 10, mathematics of 6 to 12, and physics, chemistry and biology of 11 and 12."""
    g = grade.try_cast("int")
    s = subject(subject_)
    ok = ((s == "science") & g.between(6, 10)) | ((s == "mathematics") & g.between(6, 12)) | (s.isin("physics", "chemistry", "biology") & g.isin(11, 12))
    return F.coalesce(ok, F.lit(False))


def exam_row(paper: Column, number: Column, subject_: Column, kind: Column) -> list[Column]:
    """``question_no, subject, question_type, section`` of an exam question."""
    low = F.lower(F.when(text(subject_) == "", "unknown").otherwise(subject_))
    short = _looked_up(low, SUBJECT_SHORT, F.substring(low, 1, 4))
    type_ = F.coalesce(kind, F.lit("single_correct"))
    return [
        F.concat(F.lit("p"), paper, F.lit("_"), short, F.lit("_q"), number).alias("question_no"),
        low.alias("subject"),
        type_.alias("question_type"),
        _looked_up(type_, SECTION, F.lit("A")).alias("section"),
    ]


def paper_rows(papers: DataFrame, language: str = "Hindi", exam: str = "jee_advanced") -> DataFrame:
    """One flat row for each question of nested papers (paper, year, language, source_file, questions)."""
    q = papers.select("paper", "year", F.coalesce("language", F.lit(language)).alias("language"), "source_file", F.posexplode("questions").alias("place", "q"))
    number = F.coalesce(F.col("q.question_number").cast("string"), F.lit("?"))
    options = F.transform(F.coalesce("q.options", F.array().cast(q.schema["q"].dataType["options"].dataType)), lambda o: trim(text(o["text"])))
    row = exam_row(F.col("paper").cast("string"), number, F.col("q.subject"), F.col("q.question_type"))
    return q.select(
        text("q.question_text").alias("question"), *row, options.alias("options"), "language", F.array().cast("array<string>").alias("diagram_paths"),
        "source_file", "paper", "year", F.lit(exam).alias("exam"), F.lit("").alias("answer"), "place",
    )


TYPE_HINT = {
    "single_correct": "\nPick exactly ONE option. Respond with one capital letter (A/B/C/D).",
    "multi_correct": "\nOne or more options are correct. Respond with sorted concatenated letters (e.g. 'AC').",
    "numerical": "\nThe answer is a number. Respond with a plain number (or 'a/b' fraction only if needed).",
}


def exam_prompt(subject_: Column, kind: Column, question: Column, options: Column) -> Column:
    """Prompt of a benchmark record; ``options``: array of (label, text)."""
    lines = F.array_join(F.transform(options, lambda o: F.concat(F.lit("("), trim(text(o["label"])), F.lit(") "), trim(text(o["text"])))), "\n")
    listed = F.when((kind != "numerical") & (F.coalesce(F.size(options), F.lit(0)) > 0), F.concat(F.lit("\nOptions:\n"), lines, F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("Subject: "), text(subject_), F.lit("\nQuestion type: "), kind, F.lit("\n\nQuestion (Hindi):\n"), trim(text(question)), F.lit("\n"), listed,
        _looked_up(kind, TYPE_HINT, F.lit("")), F.lit("\n\nRemember: end your response with a line of the exact form 'Final answer: <answer>'.\n"),
    )


def solver_suffix(kind: Column) -> Column:
    """What a solver is asked to end its response with, by type."""
    return (
        F.when(kind == "MCQ", "Answer with a single letter (A, B, C, or D). End your response with: Final answer: <letter>")
        .when(kind == "MCQ(multiple)", "Multiple letters from A, B, C, D may be correct. End your response with: Final answer: <letters concatenated, e.g. AC>")
        .when(kind.isin("Integer", "Numeric"), "End your response with: Final answer: <number>")
        .otherwise("End your response with: Final answer: <answer>")
    )


def json_answer(raw: Column) -> Column:
    """A JSON list joined by commas, a JSON scalar as text, else the trimmed text itself."""
    as_list = F.from_json(raw, "array<string>")
    parsed = F.try_parse_json(raw)
    scalar = F.when(~raw.rlike(r"^\s*[\[{]"), parsed.cast("string"))
    return F.coalesce(F.when(raw.rlike(r"^\s*\["), F.array_join(as_list, ",")), scalar, trim(text(raw)))

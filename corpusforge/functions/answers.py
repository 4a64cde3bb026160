"""Answer extraction: ordered rules, of which the first that finds something counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusforge.functions.text import WS, close_to, first_group, last_group, last_line, letters, plain_number, rx, tail, text, trim

# Fixed values of this module: the anchors and phrases of English and Hindi solutions.


def final_span(t: Column) -> Column:
    """After the last "final answer"; else after the first "answer is" or box; else the last line."""
    anchored = last_group(t, rx(r"Final\s+answer\s*[:\-=]\s*(.+?)(?:\n|$)", any_case=True))
    other = first_group(t, rx(r"(?:answer\s+is|\\boxed\{)\s*([^\n}]+)", any_case=True))
    return F.coalesce(trim(anchored), trim(other), last_line(t))


def declared_answer(t: Column) -> Column:
    """First letters or number after "Final answer:", or null."""
    return first_group(t, rx(r"Final answer:\s*([A-D,\s]+|-?\d+\.?\d*)", any_case=True))


def reward_answer(t: Column) -> Column:
    """Answer tag; box; anchor lines; a last line that is a bare letter or number; else empty."""
    s = text(t)
    box = trim(first_group(s, r"\\boxed\{([^}]+)\}"))
    anchors = [
        rx(r"(?:Final\s+answer|अंतिम\s+उत्तर|उत्तर)\s*[:ः\-]\s*(.+?)(?:\n|$)", any_case=True, multiline=True),
        rx(r"(?:answer)\s*[:\=]\s*\(?([A-D])\)?(?:\s|$)", any_case=True, multiline=True),
        rx(r"(?:answer)\s*[:\=]\s*(-?\d+\.?\d*)(?:\s|$)", any_case=True, multiline=True),
    ]
    lines = F.filter(F.transform(F.split(s, "\n"), trim), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    bare = F.when(last.rlike("^[A-Da-d]$"), F.upper(last)).when(last.rlike(rx(r"^-?\d+\.?\d*([eE][+-]?\d+)?$")), last)
    return F.coalesce(
        trim(first_group(s, rx(r"<answer>\s*(.*?)\s*</answer>", any_case=True, dotall=True))),
        F.when(box.rlike("^[A-Da-d]$"), F.upper(box)).otherwise(box),
        *(F.regexp_replace(trim(first_group(s, p)), r"\.+$", "") for p in anchors),
        bare,
        F.lit(""),
    )


def canonical_answer(t: Column) -> Column:
    """Lower case without a trailing dot and bracket; a bracketed option letter alone."""
    s = trim(F.regexp_replace(F.regexp_replace(F.lower(trim(text(t))), r"\.+$", ""), r"\)+$", ""))
    return F.when(s.rlike(r"^\(?[a-d]\)?$"), F.regexp_extract(s, "[a-d]", 0)).otherwise(s)


def rich_number(t: Column) -> Column:
    """A number written as decimal, fraction, multiple of pi, power, root, sum with a root, or percentage; or null."""
    s = trim(text(t))

    def when(pattern: str, make) -> Column:
        groups = [F.regexp_extract(s, pattern, i) for i in range(1, 4)]
        return F.when(s.rlike(pattern), make(*groups))

    number = lambda g: g.try_cast("double")
    factor = lambda g: F.when(g == "", 1.0).when(g == "-", -1.0).otherwise(number(g))
    pattern2 = lambda p: p + "()()()"  # noqa: E731  so that there are three groups at least
    w = r"\s*"
    return F.coalesce(
        plain_number(s),
        when(pattern2(rf"^(-?[0-9]+\.?[0-9]*){w}/{w}(-?[0-9]+\.?[0-9]*)$"), lambda a, b, c: F.try_divide(number(a), number(b))),
        when(pattern2(rf"^\\frac\{{?{w}(-?[0-9.]+){w}\}}?\{{?{w}(-?[0-9.]+){w}\}}?$"), lambda a, b, c: F.try_divide(number(a), number(b))),
        when(pattern2(rf"^\\frac\{{{w}(-?[0-9]*\.?[0-9]*){w}\\pi{w}\}}\{{{w}(-?[0-9]+\.?[0-9]*){w}\}}$"), lambda a, b, c: F.try_divide(factor(a) * F.pi(), number(b))),
        when(pattern2(rf"(?i)^(-?[0-9]*\.?[0-9]*){w}\\?pi{w}(?:/{w}(-?[0-9]+\.?[0-9]*))?$"), lambda a, b, c: F.try_divide(factor(a) * F.pi(), F.when(b == "", 1.0).otherwise(number(b)))),
        when(pattern2(r"^(-?[0-9.]+)\^\{?(-?[0-9.]+)\}?$"), lambda a, b, c: F.pow(number(a), number(b))),
        when(pattern2(r"(?i)^\\?sqrt\{?([0-9]+\.?[0-9]*)\}?$"), lambda a, b, c: F.sqrt(number(a))),
        when(pattern2(rf"^(-?[0-9.]+){w}([+\-]){w}\\?sqrt\{{?([0-9]+\.?[0-9]*)\}}?$"), lambda a, b, c: number(a) + F.when(b == "+", 1.0).otherwise(-1.0) * F.sqrt(number(c))),
        when(pattern2(rf"^(-?[0-9.]+){w}\\times{w}10\^\{{?(-?[0-9]+)\}}?$"), lambda a, b, c: number(a) * F.pow(F.lit(10.0), number(b))),
        when(pattern2(rf"^(-?[0-9.]+){w}%$"), lambda a, b, c: number(a)),
    )


def _boxed(t: pd.Series) -> pd.Series:
    """Contents of every ``\\boxed{...}`` whose braces balance, in order (no regular expression can count them)."""

    def contents(s: str | None) -> list[str]:
        found, at = [], 0
        while s and (at := s.find("\\boxed{", at)) >= 0:
            at += 7
            open_, i = 1, at
            while i < len(s) and open_:
                open_ += (s[i] == "{") - (s[i] == "}")
                i += 1
            if not open_:
                found.append(s[at : i - 1])
        return found

    return t.map(contents)


_boxed_udf = F.pandas_udf(_boxed, ArrayType(StringType()))


def boxed(solution: Column | str) -> Column:
    """Contents of the balanced boxes of a text. A text without any has none, which the JVM sees; it goes to Python as null."""
    t = F.col(solution) if isinstance(solution, str) else solution
    return F.coalesce(_boxed_udf(F.when(t.contains("\\boxed{"), t)), F.array().cast("array<string>"))


def option_letter(t: Column) -> Column:
    """1 to 4 or a letter A to D, in either case, as the letter; or null."""
    s = F.upper(trim(text(t)))
    return F.when(s.rlike("^[1-4A-D]$"), F.translate(s, "1234", "ABCD"))


def slash_fraction(t: Column) -> Column:
    r"""A whole ``\frac{a}{b}`` of plain numbers as a/b; anything else as it is."""
    pattern = r"^(-?)\\frac\{\s*([0-9.]+)\s*\}\{\s*([0-9.]+)\s*\}$"
    return F.when(trim(t).rlike(pattern), F.regexp_replace(trim(t), pattern, "$1$2/$3")).otherwise(t)


def cleaned_number(t: Column) -> Column:
    """A boxed value without spaces, units, approximations and a leading variable; null if it's an equation."""
    s = trim(t)
    for pattern, new in (
        (r"\\[,;:! ]", ""),
        (r"\\ +", " "),
        (rf"[{WS[1:-1]},\\]*\\(?:text|mathrm|rm|mbox|hbox)\{{[^}}]*\}}", ""),
        (rf"{WS}*\\approx{WS}*[0-9.]+", ""),
        (rf"[{WS[1:-1]}\\,]*\\[A-Za-z]+{WS}*$", ""),
    ):
        s = F.regexp_replace(s, pattern, new)
    s = slash_fraction(trim(F.regexp_replace(trim(s), ",+$", "")))
    pattern = rf"^\\?[A-Za-z_][A-Za-z_0-9]*{WS}*={WS}*(.+)$"
    value = slash_fraction(trim(F.regexp_extract(s, pattern, 1)))
    return trim(F.when(s.rlike(pattern), F.when(~value.contains("="), value)).otherwise(s))


def is_number_answer(t: Column) -> Column:
    """Whether a cleaned value can stand as a numeric answer."""
    bad = r"=|\\to|\\rightarrow|\\begin|\\quad|\\ldots|\\cdots"
    words = "cannot|error|no solution|undefined|does not"
    return F.coalesce(t.rlike(rx(r"\d")) & ~t.rlike(bad) & (F.char_length(t) <= 60) & ~F.lower(t).rlike(words), F.lit(False))


INCOMPLETE = (
    "cannot be determined", "cannot be solved", "question has error", "full problem statement", "share the full", "missing reaction",
    "question text is required", "please provide", "if you share", "complete question", "not enough information", "question is incomplete",
)


def repaired_number(solution: Column, boxes: Column) -> Column:
    """The number that a solution concludes, from its last usable box or its last anchors; or null. ``boxes``: :func:`boxed`."""
    low, end = F.lower(text(solution)), tail(solution, 600)
    refused = low.rlike("|".join(INCOMPLETE)) | (low.contains("no solution") & ~low.rlike(rx(r"(?:number|count)\s+of\s+(?:real\s+)?solutions")))
    usable = F.filter(F.transform(F.reverse(boxes), cleaned_number), is_number_answer)
    rules = [
        rx(r"[Ff]inal\s+[Aa]nswer\s*[:\-]\s*\$\$?\s*(-?[\d\.]+)\s*\$?\$?"),
        rx(r"[Ff]inal\s+[Aa]nswer\s*[:\-]\s*(-?[\d]+\.?[\d]*)"),
        rx(r"\*\*[Ff]inal\s+[Aa]nswer\**\s*[:\-]\s*\$?\s*(-?[\d]+\.?[\d]*)\s*\$?"),
        rx(r"[Ff]inal\s+[Aa]nswer\s*:\s*\$(-?[\d]+\.?[\d]*)\$"),
        rx(r"अंतिम\s+उत्तर\s*[:\-]?\s*\$?\s*(-?[\d]+\.?[\d]*)\s*\$?"),
        rx(r"अंतिम\s+उत्तर\s*[:\-]?\s*(-?[\d]+\.?[\d]*)"),
        rx(r"उत्तर\s*[:=]\s*\$\s*(-?[\d]+\.?[\d]*)\s*\$"),
        rx(r"(?:comes?\s+out\s+to\s+be|the\s+(?:required\s+)?value\s+is|the\s+answer\s+is|संख्या\s*=|solutions?\s+is|solutions?\s+are)\s*\$?\s*(-?\d+\.?\d*)\s*\$?", any_case=True),
    ]
    last = first_group(tail(solution, 300), rx(r"(?:answer|उत्तर|result)\D{0,30}?\$?\s*(-?\d+\.?\d*)\s*\$?", any_case=True))
    return F.when(~refused, F.coalesce(F.get(usable, F.lit(0)), *(first_group(end, p) for p in rules), last))


_N = r"(?:\$\s*)?\(?([1-4A-Da-d])\)?(?:\s*\$)?"
ENGLISH_OPTION_RULES = (
    r"(?:correct|right)\s+(?:answer|option)\s+(?:is\s+)?(?:option\s+)?" + _N,
    r"option\s+\(?([1-4A-Da-d])\)?\s+(?:is\s+)?(?:correct|right)",
    r"(?:[Hh]ence|[Tt]herefore|[Tt]hus)[,.]?\s+(?:the\s+)?(?:correct\s+)?(?:answer|option)\s+(?:is\s+)?(?:option\s+)?" + _N,
    r"[Ss]o\s+(?:the\s+)?correct\s+(?:answer|option)\s+(?:is\s+)?(?:option\s+)?" + _N,
    r"[Oo]nly\s+option\s+\(?([1-4A-Da-d])\)?\s+(?:matches|is)",
    r"corresponds\s+to\s+option\s+\(?([1-4A-Da-d])\)?",
    r"(?:answer|option)\s+(?:is\s+)?\*{1,2}\(?([1-4A-Da-d])\)?\*{1,2}",
    r"\*{1,2}option\s+\(?([1-4A-Da-d])\)?\*{1,2}",
    r"(?:correct|right)\s+(?:answer|option)\s+is\s+\$\(?([1-4A-Da-d])\)?\$",
)
HINDI_OPTION_RULES = (
    r"(?:सही|correct)\s+(?:विकल्प|उत्तर)\s+(?:है)?(?:[:\s]+)?(?:विकल्प\s+)?" + _N,
    r"(?:सही|correct).{0,50}विकल्प\s+" + _N,
    r"अतः\s+(?:सही|correct)\s+(?:विकल्प|उत्तर)\s+(?:है)?[:\s]*(?:विकल्प\s+)?" + _N,
    r"इसलिए\s+सही\s+(?:विकल्प|उत्तर)\s+(?:है)?\s*\*{0,2}" + _N + r"\*{0,2}",
    r"विकल्प\s+\*{1,2}\(?\s*([1-4A-Da-d])\s*\)?\*{1,2}",
    r"यह\s+\*{1,2}विकल्प\s+\(?([1-4A-Da-d])\)?\*{1,2}",
    r"(?:सही|correct)\s+(?:विकल्प|उत्तर)\s+है\s+\$\(?([1-4A-Da-d])\)?\$",
    r"(?:इसलिए|अतः)\s+सही\s+विकल्प\s+\$\(?([1-4A-Da-d])\)?\$",
    r"(?:सही|correct)\s+(?:विकल्प|उत्तर)\s+(?:है)?\s*\*{1,2}\(?([1-4A-Da-d])\)?",
    r"यह\s+विकल्प\s+\(?([1-4A-Da-d])\)?\s+है",
    r"\*{1,2}\(?([1-4A-Da-d])\)?\*{1,2}[^।.]{0,80}सही\s+है",
    r"([1-4])\.\s+\$[^।.]{0,120}?(?:यही\s+प्राप्त|यही\s+सही|सही\s+है|correct)",
)


def repaired_option(solution: Column, boxes: Column) -> Column:
    """The option letter that a solution concludes, from its last usable box or its last phrases; or null."""
    end = tail(solution, 800)

    def of_box(raw: Column) -> Column:
        s = trim(F.regexp_replace(trim(raw), r"(?d)^\\text\{(.+)\}$", "$1"))
        rules = (rx(r"^\\text\{\s*\(?([1-4A-Da-d])\)?"), rx(r"^\(?([1-4A-Da-d])\)?\s*(?:[^0-9]|$)"))
        return F.coalesce(*(option_letter(F.nullif(F.regexp_extract(s, p, 1), F.lit(""))) for p in rules))

    in_boxes = F.get(F.filter(F.transform(F.reverse(boxes), of_box), lambda x: x.isNotNull()), F.lit(0))
    english = [option_letter(first_group(end, rx(p, any_case=True))) for p in ENGLISH_OPTION_RULES]
    hindi = [option_letter(first_group(end, rx(p))) for p in HINDI_OPTION_RULES]
    broad = option_letter(first_group(F.right(end, F.lit(500)), rx(r"(?:answer|option)[^.?!]{0,40}\(?([1-4A-Da-d])\)?\s*[\.\s]", any_case=True)))
    return F.coalesce(in_boxes, *english, *hindi, broad)


def repaired_answer(answer: Column, solution: Column, kind: Column, boxes: Column) -> Column:
    """The answer, or for a blank one what the solution concludes: a number for numerical questions, an option for others. As it was if nothing is found."""
    found = F.when(kind == "numerical", repaired_number(solution, boxes)).otherwise(repaired_option(solution, boxes))
    return F.when(trim(text(answer)) == "", F.coalesce(F.nullif(found, F.lit("")), answer)).otherwise(answer)


def repair_report(df: DataFrame) -> DataFrame:
    """By answer type: rows (answer, solution, answer_type, boxes) with a blank answer, and for how many one is found."""
    blank = df.filter(trim(text(F.col("answer"))) == "")
    found = trim(text(repaired_answer(F.lit(""), F.col("solution"), F.col("answer_type"), F.col("boxes")))) != ""
    return blank.groupBy("answer_type").agg(F.count("*").alias("blank"), F.count_if(found).alias("extracted"), F.count_if(~found).alias("failed"))


_CONCLUSION = (
    r"(?:final\s+answer|the\s+answer\s+is|answer\s+is|अंतिम\s+उत्तर|उत्तर\s+है|सही\s+उत्तर|सही\s+विकल्प|"
    r"correct\s+(?:options?|answers?))\s*[:\-=]?\s*(.{0,150})"
)


def concluded_letters(t: Column) -> Column:
    """Option letters of the conclusion: numbered options first, else bare letters after an anchor."""
    end = tail(t, 600)
    spans = F.regexp_extract_all(end, F.lit(rx(_CONCLUSION, any_case=True)), F.lit(1))
    space = F.when(F.size(spans) > 0, F.array_join(spans, " ")).otherwise(end)
    option = rx(r"(?:option|विकल्प)\s*[\(\[\{]?\s*([1-4])|[\(\[\{]\s*([1-4])\s*[\)\]\}]")
    refs = F.transform(F.regexp_extract_all(space, F.lit(option), F.lit(0)), lambda x: F.translate(F.regexp_extract(x, "[1-4]", 0), "1234", "ABCD"))
    bare = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(r"(?<![\p{L}\p{N}_])[A-D](?![\p{L}\p{N}_])"), F.lit(0))))
    return F.array_join(F.array_sort(F.array_distinct(F.when(F.size(refs) > 0, refs).otherwise(bare))), "")


def number_candidates(t: Column) -> Column:
    """Numbers of the last 600 characters: within dollar signs, after = or ≈, then all; distinct, in order."""
    end = tail(t, 600)
    found = lambda p, g: F.regexp_extract_all(end, F.lit(p), F.lit(g))
    return F.array_distinct(
        F.concat(found(r"\$[^$]*?(-?[0-9]+\.?[0-9]*)[^$]*?\$", 1), found(rf"[=≈]{WS}*(-?[0-9]+\.?[0-9]*)", 1), found(r"-?[0-9]+\.?[0-9]*(?:[eE][+\-]?[0-9]+)?", 0))
    )


def consistent(answer: Column, solution: Column, kind: Column) -> Column:
    """Whether a solution concludes the recorded answer, by answer type; false if either is empty."""
    gold, own = trim(text(answer)), letters(text(answer))
    concluded, numbers, value = concluded_letters(solution), number_candidates(solution), plain_number(text(answer))
    near = F.exists(numbers, lambda c: close_to(plain_number(c), value, strict=True))
    by_kind = (
        F.when(kind == "mcq_single", (F.char_length(own) == 1) & concluded.contains(own))
        .when(kind == "mcq_multi", own == concluded)
        .when(kind == "numerical", F.when(value.isNull(), F.array_contains(numbers, gold)).otherwise(near))
        .otherwise(F.lower(text(solution)).contains(F.lower(gold)))
    )
    return (text(answer) != "") & (text(solution) != "") & by_kind



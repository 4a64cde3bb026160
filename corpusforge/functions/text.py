"""Text as column expressions: words, normal forms, shingles, set similarities, numbers, LaTeX.

White space, digits and letters mean what they mean for Unicode text (see :func:`rx`), so
Devanagari works like Latin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the separators U+001C to U+001F.
WS = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"


def rx(pattern: str, any_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    r"""A pattern whose ``\s``, ``\d`` and ``\D`` are Unicode's, and for which only ``\n`` ends a line."""
    flags = "d" + "iu" * any_case + "m" * multiline + "s" * dotall
    return f"(?{flags})" + pattern.replace(r"\s", WS).replace(r"\d", r"\p{Nd}").replace(r"\D", r"\P{Nd}")


def text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def trim(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def collapse(t: Column) -> Column:
    return F.regexp_replace(t, f"{WS}+", " ")


def words(t: Column) -> Column:
    """Words between white space; none of a null or blank text."""
    return F.filter(F.split(text(t), f"{WS}+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def hash_normal(t: Column) -> Column:
    """Lower case, trimmed, white space collapsed, then without what isn't a letter, number, underscore or blank."""
    return F.regexp_replace(collapse(trim(F.lower(text(t)))), rf"[^\p{{L}}\p{{N}}_{WS[1:-1]}]", "")


def lower_collapsed(t: Column) -> Column:
    return trim(collapse(F.lower(text(t))))


#: Wrappers and option marks that say nothing about a question.
SEMANTIC_STEPS = (
    (r"^(please +)?(help me|solve|answer|analyze|read carefully|select the best answer)[^\n]*?: *", ""),
    (r"(the +)?final answer +is[^\n]*$", ""),
    (r"[(\[]?\b[a-j]\b[)\].:] *", " "),
    (r"\boption +[a-j]\b", " "),
    (r"[^a-z0-9 ]", " "),
)


def semantic_normal(t: Column, unicode: bool = False) -> Column:
    """A question without wrappers and option marks, in ASCII words (or, with ``unicode``, words of any script)."""
    out = collapse(trim(F.lower(text(t))))
    for pattern, new in SEMANTIC_STEPS:
        if unicode and pattern == SEMANTIC_STEPS[-1][0]:
            pattern = r"[^\p{L}\p{M}\p{N} ]"
        out = F.regexp_replace(out, pattern, new)
    return F.trim(F.regexp_replace(out, " +", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks; none if there are fewer."""

    def runs(w: Column) -> Column:  # bound, so that the tokens are made once
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.transform(F.array(tokens), runs)[0]


def shingles(t: Column, sizes: tuple[int, ...] = (2, 3), unicode: bool = False) -> Column:
    """Distinct words and n-grams of the semantic normal form."""
    normal = semantic_normal(t, unicode)
    tokens = F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))
    bound = F.transform(F.array(tokens), lambda w: F.array_distinct(F.concat(w, *(ngrams(w, n) for n in sizes))))
    return bound[0]


def shingle_words(t: Column) -> Column:
    """Words of the semantic normal form, whose runs of up to three are the shingles; of a text without any, one token of its own normal form."""
    return F.transform(F.array(semantic_normal(t)), lambda n: F.when(n == "", F.array(F.concat(F.lit("\n"), hash_normal(t)))).otherwise(F.split(n, " ")))[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two distinct arrays; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def letters(t: Column, pattern: str = "[A-D]", fold: bool = True) -> Column:
    """Sorted distinct option letters."""
    source = F.upper(text(t)) if fold else text(t)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), F.upper))), "")


def characters(t: Column) -> Column:
    """Sorted distinct characters."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(text(t), ""), lambda c: c != ""))), "")


def first_group(t: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.get(F.regexp_extract_all(text(t), F.lit(pattern), F.lit(group)), F.lit(0))


def last_group(t: Column, pattern: str, group: int = 1) -> Column:
    """A group of the last match, or null."""
    return F.try_element_at(F.regexp_extract_all(text(t), F.lit(pattern), F.lit(group)), F.lit(-1))


def last_line(t: Column) -> Column:
    """The last line that isn't blank, trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(text(t), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"), trim), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def tail(t: Column, n: int) -> Column:
    return F.right(text(t), F.lit(n))


def ascii_digits(t: Column) -> Column:
    """Devanagari digits as ASCII ones."""
    return F.translate(t, "०१२३४५६७८९", "0123456789")


def plain_number(t: Column) -> Column:
    """A decimal number as double, or null."""
    n = ascii_digits(trim(t))
    return F.when(n.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), n.try_cast("double"))


def to_float(t: Column) -> Column:
    """A decimal number or a fraction of integers, trailing dots aside, as double, or null."""
    s = F.regexp_replace(trim(text(t)), r"\.+$", "")
    pattern = rf"^(-?[0-9]+){WS}*/{WS}*([0-9]+)$"
    num, den = F.regexp_extract(s, pattern, 1).try_cast("double"), F.regexp_extract(s, pattern, 2).try_cast("double")
    return F.when(s.rlike(pattern), F.try_divide(num, den)).otherwise(plain_number(s))


#: Commands that are dropped from a span.
LATEX_COMMANDS = r"\\(?:left|right|displaystyle|mathrm|operatorname|cdot|times|approx|pm|mp|frac|boxed|sqrt|tag|quad|qquad|;|:|,|!|\.)\b"


def latex_flat(t: Column) -> Column:
    """LaTeX with boxes and texts unwrapped (three levels), fractions of integers as a/b and commands dropped."""
    s = text(t)
    for _ in range(3):
        s = F.regexp_replace(F.regexp_replace(s, r"\\boxed\s*\{([^{}]*)\}", "$1"), r"\\text(?:bf|it|rm|sf|tt)?\s*\{([^{}]*)\}", "$1")
    s = F.regexp_replace(s, r"\\d?frac\s*\{\s*(-?[0-9]+)\s*\}\s*\{\s*(-?[0-9]+)\s*\}", "$1/$2")
    s = F.regexp_replace(s, LATEX_COMMANDS, " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\${1,2}", " "), r"\\[()\[\]]", " "), r"[{}]", " ")


def last_number(t: Column) -> Column:
    """The last fraction of a flattened span, or else its last number, as it is written (spaces in a fraction aside); empty if none."""
    flat = latex_flat(t)
    pattern = r"(-?[0-9]+)\s*/\s*([0-9]+)"
    fraction = F.concat_ws("/", last_group(flat, pattern, 1), last_group(flat, pattern, 2))
    number = last_group(flat, r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+\-]?[0-9]+)?", 0)
    return F.coalesce(F.nullif(fraction, F.lit("")), number, F.lit(""))


def close_to(value: Column, gold: Column, tolerance: float = 0.01, strict: bool = False) -> Column:
    """|value - gold| within tolerance * max(|gold|, 1); false if either is null."""
    gap, bound = F.abs(value - gold), tolerance * F.greatest(F.abs(gold), F.lit(1.0))
    return F.coalesce(gap < bound if strict else gap <= bound, F.lit(False))

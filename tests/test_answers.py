"""Expressions on literal cases: input to expected value."""

import math

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import answers as A
from corpusforge.functions import text as T
from corpusforge.operators import score, shape


def values(spark, cases, f):
    rows = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)])
    args = [F.col(c) for c in rows.columns[1:]]
    return [r["x"] for r in rows.select("_1", f(*args).alias("x")).orderBy("_1").collect()]


def test_normal_forms(spark):
    cases = ["  Hello,\u00a0World!  ", "सही  उत्तर", "", "Answer: (a) x. Final answer is 3", "option b is Big"]
    assert values(spark, cases, T.hash_normal)[0] == "hello world"
    assert values(spark, cases, T.word_count) == [2, 2, 0, 7, 4]
    assert values(spark, cases, T.semantic_normal)[2:] == ["", "x", "is big"]
    assert values(spark, ["सही"], T.hash_normal) == ["".join(c for c in "सही" if c.isalnum())]


def test_shingles_guard_short_texts(spark):
    assert values(spark, ["one", "one two", "", "a1 b1 c1 a1"], lambda t: F.size(T.shingles(t))) == [1, 3, 0, 8]


def test_final_span(spark):
    cases = ["Final answer: A\nx\nFINAL ANSWER - b \nz", "so the answer is 42\nbye", "\\boxed{7}", "one\n two \n\n", ""]
    assert values(spark, cases, A.final_span) == ["b", "42", "7", "two", ""]


@pytest.mark.parametrize(
    ("given", "want"),
    [("4.25", 4.25), ("-3/4", -0.75), ("1/0", None), ("\\frac{1}{2}", 0.5), ("\\frac{3\\pi}{4}", 3 * math.pi / 4), ("-\\pi", -math.pi), ("2^{-1}", 0.5), ("\\sqrt{9}", 3.0), ("sqrt(9)", None), ("4-\\sqrt{4}", 2.0), ("2 \\times 10^{3}", 2000.0), ("1.5%", 1.5), ("x", None), ("1d", None)],
)
def test_rich_number(spark, given, want):
    got = values(spark, [given], A.rich_number)[0]
    assert got is None if want is None else got == pytest.approx(want)


def test_reward_answer(spark):
    cases = ["<answer> B </answer>", "\\boxed{c}", "Final answer: 12.", "अंतिम उत्तर: 5", "so\nd", "no"]
    assert values(spark, cases, A.reward_answer) == ["B", "C", "12", "5", "D", ""]


def test_boxes_balance(spark):
    got = values(spark, ["\\boxed{\\frac{1}{2}} and \\boxed{x", "none"], lambda t: A.boxed(t))
    assert got == [["\\frac{1}{2}"], []]


def test_repairs(spark):
    both = lambda f: lambda t: f(t, A.boxed(t))
    cases = ["\\boxed{x = 5\\text{ cm}}", "\\boxed{a=b=c} Final answer: 7", "cannot be determined \\boxed{3}", "अंतिम उत्तर: 12", "the value is $4$"]
    assert values(spark, cases, both(A.repaired_number)) == ["5", "7", None, "12", "4"]
    cases = ["\\boxed{(2)}", "The correct answer is option (3).", "सही विकल्प है: विकल्प (C)", "nothing here"]
    assert values(spark, cases, both(A.repaired_option)) == ["B", "C", "C", None]


def test_consistency(spark):
    cases = [("A", "the answer is option 1", "mcq_single"), ("AC", "correct options: (1) and (3)", "mcq_multi"), ("100", "so x = 100.5", "numerical"), ("100", "x = 101", "numerical"), ("", "x", "numerical")]
    assert values(spark, cases, A.consistent) == [True, True, True, False, False]


def test_scores(spark):
    cases = [("single_correct", "Final answer: b", "B"), ("multi_correct", "Final answer: C,A", "AC"), ("numerical", "Final answer: 101", "100"), ("numerical", "Final answer: 102", "100"), ("essay", "Final answer: b", "B")]
    assert values(spark, cases, score.by_type) == [1, 1, 1, 0, 0]
    assert values(spark, [("101", "100"), ("100.9", "100"), ("final answer: 0.005", "0"), ("a, c", "AC"), ("x", "")], score.open_score) == [0, 1, 1, 1, 0]


def test_rewards(spark):
    assert values(spark, [("Final answer: (b)", "B"), ("<answer>1.03</answer>", "1"), ("<answer>0</answer>", "0"), ("none", "x")], score.correctness_reward) == [2.0, 0.5, 2.0, 0.0]
    hindi = "यह एक प्रश्न है जिसका उत्तर हिंदी में है"
    assert values(spark, [(hindi, "यह सही है और यह गलत है का की के"), ("short", hindi)], score.hindi_reward) == [0.25, 0.0]
    assert values(spark, ["a\nb", "same line\nsame line\nsame line", "one line only here"], score.repetition_reward) == [0.0, 0.1, 0.0]


def test_json_answers(spark):
    assert values(spark, ['["A","B"]', '"C"', " raw ", "7"], shape.json_answer) == ["A,B", "C", "raw", "7"]

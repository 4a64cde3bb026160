"""Arithmetic, tasks, generated solutions, embedders, runs, reused rows and the near-duplicate gates."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.functions.arithmetic import equation_value, right_side
from corpusforge.operators import neardup, score, shape, solutions, tasks
from corpusforge.operators.embed import embed, with_retries
from corpusforge.plans.evaluation import word_embedder
from corpusforge.sources import policies, runs


@pytest.mark.parametrize(
    ("equation", "wanted"),
    [
        ("x = 2+3*4", "14"), ("x=-(2**3**2)", "-512"), ("x=-2**2", "-4"), ("x=2**-1", "0.5"), ("x=1/3", "0.3333"), ("x=7//2%2", "1"), ("x = 3 = 4", "3"),
        ("x=1/0", None), ("x=9**9**9", None), ("x=(1", None), ("x=1)", None), ("x=1 2", None), ("x=()", None), ("x=a", None), ("x", None), ("", None), (None, None),
        ("x=" + "(" * 50_000 + "1" + ")" * 50_000, "1"), ("x=" + "1+" * 50_000 + "1", "50001"), ("x=(-1)**0.5", None),
    ],
)
def test_equations(equation, wanted):
    assert right_side(equation) == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=2, max_size=6), st.lists(st.sampled_from(["+", "-", "*", "//", "%"]), min_size=5, max_size=5))
def test_equations_by_python(numbers, ops):
    text = "".join(f"{n} {o} " for n, o in zip(numbers, ops)) + "3"
    try:
        wanted = str(eval(text))
    except ZeroDivisionError:
        wanted = None
    assert right_side("y = " + text) == wanted


def test_equation_column(spark):
    df = spark.createDataFrame([(1, "x = 1 + 1"), (2, None), (3, "")], "i INT, e STRING").select("i", equation_value(F.col("e")).alias("v"))
    assert {r.i: r.v for r in df.collect()} == {1: "2", 2: None, 3: None}


def test_absolute_is_strict(spark):
    row = spark.range(1).select(score.absolute(F.lit("1.0"), F.lit("1.5")).alias("a"), score.absolute(F.lit("x"), F.lit("1")).alias("b"), score.absolute(F.lit("2"), F.lit("2.00001")).alias("c"), score.absolute(F.lit("0.5"), F.lit("1"), 0.5).alias("d")).first()
    assert tuple(row) == (0, 0, 1, 0)


def test_tasks(spark, tmp_path):
    path = f"{tmp_path}/many.jsonl"
    with open(path, "w") as f:
        for r in (
            {"question": " Q ", "options": ["a", " ", None, "d"], "answer": "d", "answer_index": 3, "category": " गणित "},
            {"question": "Q", "options": ["a"], "answer": "B", "answer_index": 7, "category": "भौतिकी"},
            {"question": "Q", "options": ["a"], "answer": "A", "answer_index": 0, "category": None},
        ):
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
    rows = tasks.load(spark, "many_options", f"{tmp_path}/none.jsonl", path).collect()
    assert [(r.choices, r.target) for r in rows] == [(["A", "D"], 1), (["A"], 7)]
    assert rows[0].input == "Q\n\nA) a\nD) d\n\nAnswer:"
    with open(f"{tmp_path}/words.json", "w") as f:
        json.dump([{"Problem": "p", "Equation": "x = 3/2"}, {"Problem": "q", "Equation": "none"}], f, indent=1)
    assert [r.target for r in tasks.load(spark, "word_problems", f"{tmp_path}/words.json").collect()] == ["1.5", None]
    empty = tasks.exam_samples(spark.createDataFrame([], tasks.TASKS["exam_main"].schema), "x")
    assert empty.count() == 0
    nulls = tasks.exam_samples(spark.createDataFrame([(None,) * 11], tasks.TASKS["exam_main"].schema), "x").first()
    assert (nulls.target, nulls.metadata.exam, nulls.metadata.subject, nulls.metadata.question_type, nulls.metadata.has_diagram) == ("", "x", "unknown", "single_correct", False)


def test_joined_parts(spark):
    rows = [(1, [("text", "a "), ("image", None), ("text", "b")]), (2, []), (3, None)]
    got = spark.createDataFrame(rows, "i INT, p ARRAY<STRUCT<type STRING, text STRING>>").select("i", shape.joined_parts(F.col("p")).alias("t"))
    assert {r.i: r.t for r in got.collect()} == {1: "a b", 2: "", 3: None}


def test_selected_names():
    assert tasks.select(["D1", "D2", "D3"], skip=["d2"]) == ["D1", "D3"]
    assert tasks.select(["D1", "D2"], only=["d2"]) == ["D2"]
    with pytest.raises(ValueError):
        tasks.select(["D1"], skip=["D9"])


def test_solutions(spark):
    long = "w " * 20
    raw = [
        json.dumps({"solution": long, "answer": "c, a a", "answer_type": "mcq_multi", "subject": "physics"}), "```json\n" + json.dumps({"solution": long, "answer": " 2 ", "answer_type": "numerical"}) + "\n```",
        json.dumps({"solution": "short", "answer": "A"}), json.dumps({"solution": long, "answer": " "}), json.dumps({"answer": "A"}), "[1]", "{", None,
    ]
    rows = spark.createDataFrame([(i, r, None, None, None, "q", None, "f") for i, r in enumerate(raw)], "i INT, raw STRING, subject STRING, level STRING, options ARRAY<STRING>, question STRING, question_no STRING, source_file STRING")
    judged = solutions.judged(rows, "raw")
    got = {r.i: (r.reason, r.generated and r.generated.answer) for r in judged.collect()}
    assert [got[i][0] for i in range(8)] == [None, None, "too_short", "no_answer", "no_solution", "not_json", "not_json", "not_json"]
    assert got[0][1] == "AC" and got[1][1] == "2"
    records = {r.answer: r for r in solutions.records(judged.filter("reason is null")).collect()}
    assert records["AC"].group == "physics_JEE_Advanced" and records["2"].group == "unknown_JEE_Advanced" and records["2"].options == []
    assert tuple(solutions.summary(judged).first()) == (8, 2, 6, 25.0)
    assert tuple(solutions.summary(judged.limit(0)).first()) == (0, 0, 0, 0.0)
    names = spark.createDataFrame([("a/b c.x.pdf",), (None,), ("p/.hidden",), ("y" * 80 + ".pdf",)], "n STRING")
    assert [r[0] for r in names.select(solutions.question_id(F.col("n"), F.lit("7"))).collect()] == ["b_c_x_Q7", "unknown_Q7", "_hidden_Q7", "y" * 60 + "_Q7"]


def test_embedder(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else "a b" * i) for i in range(40)], "k LONG, t STRING").repartition(3)
    got = {r.k: r.embedding for r in embed(rows, "k", "t", lambda: lambda texts: [[len(t), 1] for t in texts], batch=4).collect()}
    assert got == {i: [0.0 if i == 3 else 3.0 * i, 1.0] for i in range(40)}
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError
        return texts

    assert with_retries(flaky, wait=0)(["x"]) == ["x"] and len(calls) == 3
    with pytest.raises(OSError):
        calls.clear()
        with_retries(flaky, tries=2, wait=0)(["x"])


def test_runs(spark, tmp_path):
    results = spark.createDataFrame([("t", 1, "acc", 0.1), ("t", 2, "acc", 0.2), ("u", 1, "acc", 0.3)], "task STRING, phase INT, metric STRING, value DOUBLE")
    samples = spark.createDataFrame([("t", "s")], "task STRING, input STRING")
    path = runs.write_run(str(tmp_path), "r1", {"model": "म", "n": 1}, results, samples)
    assert runs.read_log(spark, f"{path}/config") == {"model": "म", "n": 1}
    assert {(r.task, r.value) for r in runs.merged(spark.read.parquet(f"{path}/results")).collect()} == {("t", 0.2), ("u", 0.3)}
    with pytest.raises(Exception, match="(?i)exist"):
        runs.write_run(str(tmp_path), "r1", {}, results, samples)


def test_reused_rows(spark):
    ddl = "i INT, conversations ARRAY<STRUCT<`from` STRING, value STRING>>"
    rows = [(1, [("human", ""), ("human", "q"), ("gpt", "a")]), (2, [("human", "q")]), (3, [("gpt", "a"), ("human", None)]), (4, None)]
    got = {r.i: (r.question, r.reason) for r in policies.reused(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: ("q", None), 2: ("q", "malformed"), 3: (None, "no_question"), 4: (None, "malformed")}
    places = [(0, 0, "a", False), (1, 0, "A", True), (1, 1, "a", True), (1, 2, "b", True), (2, 0, "b", False), (2, 1, "c", False), (2, 2, "c", False)]
    kept = policies.with_reused(spark.createDataFrame(places, "prio INT, ord LONG, question STRING, anchored BOOLEAN"))
    assert sorted((r.prio, r.ord) for r in kept.collect()) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 1)]


def _gates_by_hand(rows, c):
    """All pairs of representatives by the gates, then groups."""
    q = {i: " ".join((t or "").lower().split()) for i, t in rows}
    first = {}
    for i in sorted(q):
        first.setdefault(q[i], i)
    labels = {(first[q[i]], i): "exact_hash" for i in q if first[q[i]] != i}
    one, two = ({i: np.asarray(call([dict(rows)[i] or ""])[0]) for i in first.values()} for call in (word_embedder(), word_embedder(512, 1)))
    cos = lambda v, i, j: v[i] @ v[j] / max(np.linalg.norm(v[i]) * np.linalg.norm(v[j]), 1e-9)
    for i, j in itertools.combinations(sorted(first.values()), 2):
        a, b = set(q[i].split()), set(q[j].split())
        sim = len(a & b) / len(a | b) if a | b else 1.0
        if cos(one, i, j) >= c.semantic and sim >= c.borderline and (sim >= c.confirmed or cos(two, i, j) >= c.second):
            labels[i, j] = "wordllama_jaccard" if sim >= c.confirmed else "nomic_confirmed"
    root = {i: i for pair in labels for i in pair}
    for _ in root:
        for i, j in labels:
            root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for g in set(root.values()):
        of = {i for i in root if root[i] == g}
        found = {x for (i, _), x in labels.items() if i in of}
        keep = min(of, key=lambda i: (-len(dict(rows)[i] or ""), i))
        groups[g] = (keep, len(of), next(x for x in ("exact_hash", "nomic_confirmed", "wordllama_jaccard") if x in found))
    return groups


def test_near_duplicate_gates(spark, tmp_path):
    base = [" ".join(f"w{(k * 7 + j) % 50}" for j in range(12)) for k in range(6)]
    texts = [*base, base[0].upper(), base[0] + " x", base[1] + " y z", base[2] + " p q r s t u", None, "", "  ", base[3][:-4], base[4] + "\n" + base[4], base[5] + " " + " ".join(f"n{i}" for i in range(8))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "k LONG, t STRING, id STRING")
    c = neardup.NearDupConfig(semantic=0.6, second=0.7, folder=str(tmp_path), all_pairs=True)
    found = neardup.near_duplicates(df, "k", "t", "t", word_embedder, lambda: word_embedder(512, 1), c)
    wanted = _gates_by_hand(rows, c)
    assert {r.group_id: (r.keep, r["size"], r.confidence) for r in found.groups.collect()} == wanted
    assert len({w[2] for w in wanted.values()}) >= 2
    removed = sum(n - 1 for _, n, _ in wanted.values())
    assert tuple(found.summary.first()) == (len(rows), removed, len(rows) - removed, round(removed / len(rows) * 100, 2))

    def never():
        raise AssertionError("a kept gate ran again")

    again = neardup.near_duplicates(df, "k", "t", "t", never, never, c)
    assert {r.group_id for r in again.groups.collect()} == set(wanted)
    nothing = neardup.near_duplicates(df.limit(0), "k", "t", "t", word_embedder, word_embedder)
    assert nothing.groups.count() == 0 and tuple(nothing.summary.first()) == (0, 0, 0, 0.0)


def test_only_rows_alike_by_words_are_embedded(spark):
    base = [" ".join(f"w{(k * 7 + j) % 50}" for j in range(12)) for k in range(6)]
    texts = [*base, base[0].upper(), base[0] + " x", base[1] + " y z", base[2] + " p q r s t u", None, "", base[4] + "\n" + base[4], base[5] + " " + " ".join(f"n{i}" for i in range(8)), "nothing like this"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "k LONG, t STRING")

    def embedder():
        def call(batch):
            if any(t is None or "nothing" in t for t in batch):
                raise AssertionError("a row without a partner was embedded")
            return word_embedder()(batch)

        return call

    c = neardup.NearDupConfig(semantic=0.6, second=0.7)
    found = neardup.near_duplicates(df, "k", "t", "t", embedder, lambda: word_embedder(512, 1), c)
    assert {r.group_id: (r.keep, r["size"], r.confidence) for r in found.groups.collect()} == _gates_by_hand(rows, c)

"""The builder, records, chat texts, shots, repair, resumed work and the mapping of duplicates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import answers as A
from corpusforge.functions import text as T
from corpusforge.operators import neardup, shape, tasks
from corpusforge.plans.evaluation import word_embedder
from corpusforge.sources import builder, runs

SYN = "ord long, conversations array<struct<`from` string, value string>>, instruction string, output string"


def source(spark, name, questions, **more):
    rows = [(i, None, q, "answer") for i, q in enumerate(questions)]
    return builder.Source(name, "synthetic", lambda s: s.createDataFrame(rows, SYN), **more)


def shingles(q):
    w = q.split()
    return {*w, *(" ".join(w[i : i + 2]) for i in range(len(w) - 1)), *(" ".join(w[i : i + 3]) for i in range(len(w) - 2))}


def by_hand(sources, targets, near):
    """The loop in order: (source, ord) of the rows that are kept."""
    kept, out = [], []
    for name, questions in sources.items():
        n = 0
        for i, q in enumerate(questions):
            if n == targets.get(name, 10**9):
                break
            s = shingles(q)
            alike = lambda o: q == o or near and bool(s and (x := shingles(o))) and (len(s & x) / len(s | x) >= 0.8 or len(s & x) / min(len(s), len(x)) >= 0.9)  # noqa: E731, B023
            if not any(map(alike, kept)):
                kept.append(q)
                out.append((name, i))
                n += 1
    return sorted(out)


@pytest.mark.parametrize("near", [True, False])
def test_build_is_the_loop_in_order(spark, near):
    r = random.Random(4)
    base = [" ".join(r.choice("pqrstuvwxyz") + r.choice("lmno") for _ in range(r.randint(4, 25))) for _ in range(30)]

    def edited(q):
        w = q.split()
        w[r.randrange(len(w))] = "zz"
        return " ".join(w[r.randrange(3) :])

    sources = {n: [r.choice((lambda q: q, edited))(r.choice(base)) for _ in range(40)] for n in ("D1", "D2", "SYN")}
    targets = {"D1": 15, "D2": 5}
    registry = builder.Registry(*(source(spark, n, q, target=targets.get(n)) for n, q in sources.items()))
    rows, report = builder.build(spark, registry, builder.BuildConfig(duplicates="near" if near else "exact"))
    assert sorted((x["source_id"], x["ord"]) for x in rows.collect()) == by_hand(sources, targets, near)
    assert sum(x["n"] for x in report.collect()) == rows.count()
    some, _ = builder.build(spark, registry, builder.BuildConfig(skip=("d1",), duplicates="off", targets={"D2": 7}))
    assert sorted((x["source_id"], x["ord"]) for x in some.collect()) == [("D2", i) for i in range(7)] + [("SYN", i) for i in range(40)]


def test_build_with_reused_rows(spark):
    q = ["one two three four", "five six seven eight", "one two three four"]
    registry = builder.Registry(source(spark, "D1", ["never read"]), source(spark, "SYN", [*q, "nine ten eleven twelve"]))
    reused = spark.createDataFrame([(i, [("human", t), ("gpt", "a")]) for i, t in enumerate((q[0], q[0]))], "ord long, conversations array<struct<`from` string, value string>>")
    rows, _ = builder.build(spark, registry, builder.BuildConfig(reuse=("d1",), reused={"D1": reused}))
    assert sorted((x["source_id"], x["ord"]) for x in rows.collect()) == [("D1", 0), ("D1", 1), ("SYN", 1), ("SYN", 3)]
    with pytest.raises(ValueError, match="unknown"):
        builder.build(spark, registry, builder.BuildConfig(skip=("D9",)))
    schema, first = registry.peek(spark, "SYN")
    assert "instruction:string" in schema and [x["instruction"] for x in first] == q[:2]
    empty = builder.Registry(source(spark, "SYN", []))
    assert builder.build(spark, empty)[0].count() == 0 and sum(builder.TARGETS.values()) == 139_000


def test_records(spark):
    rows = spark.createDataFrame([("q", "a", "c1", None), ("q", None, None, ["k"])], "question string, answer string, chunk_id string, key_concepts array<string>")
    got = shape.record(rows).collect()
    assert [x["metadata"]["source_chunk_id"] for x in got] == ["c1", "unknown"] and [x["metadata"]["key_concepts"] for x in got] == [[], ["k"]]
    assert len(got[0]["metadata"]) == 8 and [t["from"] for t in got[0]["conversations"]] == ["human", "gpt"]
    assert shape.record(rows.limit(0)).count() == 0


def test_chat_texts(spark):
    rows = spark.createDataFrame([([("system", "s"), ("human", " q "), ("gpt", "a"), ("tool", None)],), ([],), (None,)], "turns array<struct<`from` string, value string>>")
    got = [x[0] for x in rows.select(shape.rendered(F.col("turns"))).collect()]
    assert got == ["<start_of_turn>system\ns<end_of_turn>\n<start_of_turn>user\nq<end_of_turn>\n<start_of_turn>model\na<end_of_turn>\n\n", "", None]
    plain = shape.ChatTemplate("", {"user": ("U: ", "\n")}, ("> ", "\n"))
    assert rows.limit(1).select(shape.rendered(F.col("turns"), plain)).first()[0] == "> s\nU: q\n> a\n> \n"


def test_papers(spark):
    schema = "paper int, year int, language string, source_file string, questions array<struct<question_number int, question_text string, subject string, question_type string, options array<struct<label string, text string>>>>"
    rows = [(1, 2025, None, "p.json", [(3, " t", "Physics", None, [("A", " x "), ("B", None)]), (None, None, None, "numerical", None)]), (2, 2025, "English", "q.json", [])]
    got = shape.paper_rows(spark.createDataFrame(rows, schema)).orderBy("place").collect()
    assert [(x["question_no"], x["section"], x["options"], x["language"], x["question"]) for x in got] == [("p1_phys_q3", "A", ["x", ""], "Hindi", " t"), ("p1_unkn_q?", "B", [], "Hindi", "")]


def test_shots(spark):
    samples = spark.createDataFrame([("q1", "A"), ("q2", "B")], "input string, target string")
    shown = spark.createDataFrame([("s2", 1), ("s1", 0), ("s3", 2)], "input string, target int")
    assert [x["input"] for x in tasks.with_shots(samples, shown, 2, "input").orderBy("input").collect()] == [f"s1 0\n\ns2 1\n\n{q}" for q in ("q1", "q2")]
    assert tasks.with_shots(samples, shown.limit(0), 2, "input").count() == 2 and tasks.with_shots(samples, shown, 0).columns == samples.columns


def test_blank_answers_are_repaired(spark):
    rows = [("", "so \\boxed{7}", "numerical"), (" ", "the correct option is (2)", "mcq_single"), ("kept", "\\boxed{7}", "numerical"), (None, "nothing", "mcq_multi"), (None, None, "numerical")]
    df = spark.createDataFrame(rows, "answer string, solution string, answer_type string").withColumn("boxes", A.boxed("solution"))
    got = [x[0] for x in df.select(A.repaired_answer(F.col("answer"), F.col("solution"), F.col("answer_type"), F.col("boxes"))).collect()]
    assert got == ["7", "B", "kept", None, None]
    assert {x["answer_type"]: (x["blank"], x["extracted"], x["failed"]) for x in A.repair_report(df).collect()} == {"numerical": (2, 1, 1), "mcq_single": (1, 1, 0), "mcq_multi": (1, 0, 1)}


def test_declared_answers(spark):
    rows = spark.createDataFrame([("Final answer: A, C",), ("x\nfinal ANSWER: -2.5 m",), ("none",), (None,)], "t string")
    assert [x[0] for x in rows.select(T.trim(A.declared_answer(F.col("t")))).collect()] == ["A, C", "-2.5", None, None]


def test_checkpoints(spark, tmp_path):
    path = f"{tmp_path}/done"
    rows = lambda *x: spark.createDataFrame(x, "k long, r string")
    runs.write_checkpoint(rows((1, "one"), (2, None), (3, None)), path, "k", "r")
    runs.write_checkpoint(rows((2, "two"), (3, None), (1, "one")), path, "k", "r")
    found = runs.checkpoint(spark, path)
    assert sorted((x["key"], x["status"], x["record"]) for x in found.collect()) == [("1", "ok", "one"), ("2", "ok", "two"), ("3", "failed", None)]
    assert tuple(runs.resumable(found).first()) == (2, 1)


def test_gates_are_kept_by_their_input(spark, tmp_path):
    config = neardup.NearDupConfig(folder=str(tmp_path), skip_second=True)
    of = lambda *texts: neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", "t", word_embedder, config=config)
    assert of("same text", "same text", "other").groups.count() == 1
    assert of("same text", "some words", "other").groups.count() == 0
    found = of("same text", "same text", "other")
    lines = {x["kind"]: json.loads(x["line"]) for x in neardup.mapping(found, "d").collect()}
    assert lines["group"] == {"group_id": 0, "keep": 0, "remove": [1], "size": 2, "confidence": "exact_hash"}
    assert lines["summary"] == {"dataset": "d", "total": 3, "removed": 1, "kept": 2, "reduction_pct": 33.33, "removed_by_gate": {"exact_hash": 1}}


def test_near_copies_of_a_source_with_a_target_beyond_its_first_rows(spark, monkeypatch):
    """Rows are gone through in order until the target is reached, as often as it takes; whole rows aren't written beforehand."""
    seen, table = [], builder.table

    def kept(df, label, *codec):
        seen.append((label, df.columns))
        return table(df, label, *codec)

    monkeypatch.setattr(builder, "table", kept)
    monkeypatch.setattr(builder._near, "__defaults__", (None, 4))
    base = ["one two three four five six", "seven eight nine ten eleven", "red green blue white black"]
    questions = [base[0]] * 9 + [base[1]] * 9 + [base[0] + " x", base[2], "never reached at all here"]
    registry = builder.Registry(source(spark, "SYN", questions, target=3))
    rows, _ = builder.build(spark, registry)
    assert sorted(x["ord"] for x in rows.collect()) == [x[1] for x in by_hand({"SYN": questions}, {"SYN": 3}, True)]
    assert [c for label, c in seen if label.startswith("source-")] == [["id", "question"]]

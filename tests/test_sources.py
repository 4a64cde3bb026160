import json

import pytest

from corpusforge.sources import files, policies
from corpusforge.streaming.ingest import ingest

LONG = " ".join(["word"] * 50)
COT = "ord long, problem string, generated_solution string, problem_type string, problem_source string"
SYN = "ord long, conversations array<struct<`from` string, value string>>, instruction string, output string"


def reasons(df, policy):
    return {r["ord"]: r["reason"] for r in policies.judged(df, policy, "ord").collect()}


def test_math_cot(spark):
    ok = "has_answer_extracted"
    rows = [(1, "p", LONG, ok, None), (2, "", LONG, ok, None), (3, "p", None, ok, None), (4, "p", LONG, None, None), (5, "p", "x " * 49, ok, None), (6, "p", "x " * 3001, ok, None)]
    df = spark.createDataFrame(rows, COT)
    assert reasons(df, "math_cot") == {1: None, 2: "missing", 3: "missing", 4: "no_answer", 5: "too_short", 6: "too_long"}
    first = policies.judged(df, "math_cot", "ord").filter("ord = 1").first()
    assert first["metadata"] == {"source": "math_cot", "problem_source": "unknown"}
    assert [t["from"] for t in first["conversations"]] == ["human", "gpt"]
    assert policies.judged(df.limit(0), "math_cot", "ord").count() == 0


def test_math_reasoning(spark):
    df = spark.createDataFrame([(1, "p", LONG, 1), (2, "p", LONG, 0), (3, "p", LONG, None)], "ord long, problem string, solution string, correctness_count int")
    assert reasons(df, "math_reasoning") == {1: None, 2: "not_verified", 3: "not_verified"}


def test_messages(spark):
    m = "array<struct<role string, content string>>"
    df = spark.createDataFrame([(1, "p", [("user", "p"), ("assistant", LONG), ("assistant", "")], None, None), (2, "p", None, None, None)], f"ord long, problem string, messages {m}, data_source string, tool_usage string")
    assert reasons(df, "math_messages") == {1: None, 2: "missing"}
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "w " * 20)], None, "RQA"), (2, [("user", "q"), ("assistant", "w " * 19)], None, None), (3, None, None, None)], f"ord long, messages {m}, used_in string, split string")
    assert reasons(df, "science_messages") == {1: None, 2: "too_short", 3: "missing"}


def test_thoughts(spark):
    rows = [(1, "Maths", [("human", "q"), ("gpt", LONG)]), (2, "Code", [("human", "q"), ("gpt", LONG)]), (3, "x", [("gpt", LONG)])]
    df = spark.createDataFrame(rows, "ord long, domain string, conversations array<struct<`from` string, value string>>")
    assert reasons(df, "thoughts") == {1: None, 2: "code", 3: "missing"}


def test_mcq_image(spark):
    schema = "ord long, image binary, question string, choices array<string>, answer int, lecture string, solution string"
    rows = [(1, None, "q", ["a", "b"], 1, LONG, ""), (2, b"x", "q", ["a"], 0, LONG, None), (3, None, "q", ["a"], 1, LONG, None), (4, None, "q", ["a"], -1, LONG, None), (5, None, "q", ["a"], 0, "", None), (6, None, "q", ["a"], 0, "short", "more")]
    df = spark.createDataFrame(rows, schema)
    assert reasons(df, "mcq_image") == {1: None, 2: "image", 3: "no_such_choice", 4: "no_such_choice", 5: "missing", 6: "too_short"}
    first = policies.judged(df, "mcq_image", "ord").filter("ord = 1").first()
    assert first["question"] == "q\n\nA) a\nB) b"
    assert first["answer"] == f"The correct answer is: b\n\n{LONG}"


def test_sciq_and_school(spark):
    df = spark.createDataFrame([(1, "q", "a", "s " * 10), (2, "q", "a", None), (3, "q", "", "s " * 10)], "ord long, question string, correct_answer string, support string")
    assert reasons(df, "sciq")[1] is None and reasons(df, "sciq")[2] == "no_explanation" and reasons(df, "sciq")[3] == "missing"
    df = spark.createDataFrame([(1, "q", LONG, "Maths", "7"), (2, "q", LONG, "physics", "9"), (3, "q", "short", "maths", "7")], "ord long, Question string, response string, topic string, Class string")
    assert reasons(df, "school") == {1: None, 2: "out_of_grade", 3: "too_short"}
    with pytest.raises(ValueError, match="none of the columns"):
        policies.judged(df.drop("response"), "school", "ord")


def test_corpus_keeps_the_first_source(spark):
    cot = spark.createDataFrame([(1, "What is it?", LONG, "has_answer_extracted", "s"), (2, "Other", LONG, None, "s")], COT)
    rows = [(1, [("human", "what IS  it"), ("gpt", "x")], None, None), (2, None, "Other", "y"), (2, None, "Other", "y"), (3, [("human", "z")], None, None), (4, None, "q", "")]
    got = policies.corpus({"math_cot": cot, "synthetic": spark.createDataFrame(rows, SYN)})
    assert sorted((r["prio"], r["ord"]) for r in got.collect()) == [(0, 1), (8, 2)]


def test_files(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"a": 1, "b": "é"}\n\nnot json\n{"a": 2}\n', encoding="utf-8")
    df = files.read_lines(spark, str(path), "a long, b string")
    assert sorted((r["a"] or 0, r[files.MALFORMED]) for r in df.collect()) == [(0, "not json"), (1, None), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_lines(spark, str(path), "a long, b string", strict=True).collect()
    out = str(tmp_path / "out")
    files.write_lines(df.filter("a is not null").drop(files.MALFORMED), out)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert sorted(lines, key=lambda x: x["a"]) == [{"a": 1, "b": "é"}, {"a": 2, "b": None}]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_lines(df, out)
    assert files.resolve(spark, str(tmp_path / "none"), str(path)) == str(path)
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, str(tmp_path / "none"))
    doc = tmp_path / "doc.json"
    doc.write_text('{"book": "b",\n "qa": [{"q": "1"}, {"q": "2"}]}')
    assert [tuple(r) for r in files.read_nested(spark, str(doc), "book string, qa array<struct<q string>>", "qa").collect()] == [("b", 0, "1"), ("b", 1, "2")]
    assert files.folder_name("D4", "Open-Thoughts 3") == "d4_open_thoughts_3"
    assert files.unfinished(df, df.filter("a = 1"), "a").count() == 2


def test_ingest(spark, tmp_path):
    src, out, ck = (tmp_path / n for n in ("src", "out", "ck"))
    src.mkdir()
    for n, row in enumerate([{"ord": 1, "instruction": "q", "output": "a"}, {"ord": 2, "instruction": "", "output": "a"}]):
        (src / f"{n}.json").write_text(json.dumps(row))
        ingest(spark, str(src), SYN, "synthetic", "ord", str(out), str(ck)).awaitTermination(60)
    assert sorted((r["ord"], r["accepted"]) for r in spark.read.parquet(str(out)).selectExpr("ord", "accepted = 'true' as accepted").collect()) == [(1, True), (2, False)]

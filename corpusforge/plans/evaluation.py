"""Queries of tasks, generated solutions, reused rows, distributions and the near-duplicate gates."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusforge.functions.arithmetic import equation_value
from corpusforge.operators import neardup, quality, score, shape, solutions, tasks
from corpusforge.plans.catalogue import _docs, _read, _sql_hash_normal, _sql_trim, _sql_words, _turn_sql, query
from corpusforge.sources import policies

# Tasks


def _equation():
    return F.concat(F.lit("x = ("), "l_linenumber", F.lit(" + "), "l_partkey", F.lit(") * 3 - "), "l_suppkey", F.lit(" * -2"))


@query("SELECT l_orderkey, l_linenumber, ((l_linenumber + l_partkey) * 3 + l_suppkey * 2)::VARCHAR AS target FROM lineitem")
def equation_targets(spark, sf):
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", equation_value(_equation()).alias("target"))


@query("SELECT l_orderkey, l_linenumber, (abs(l_quantity - (l_quantity + (l_linenumber - 1) * 0.00005::DOUBLE)) < 0.0001::DOUBLE)::INT AS score FROM lineitem")
def score_absolute(spark, sf):
    shifted = (F.col("l_quantity") + (F.col("l_linenumber") - 1) * 0.00005).cast("string")
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.absolute(F.col("l_quantity").cast("string"), shifted).alias("score"))


@query(
    """WITH c AS (SELECT p_partkey, [p_name, p_brand, p_type] AS o, [-1.0 * (p_size % 7), -1.0 * (p_partkey % 5), -2.5] AS s FROM part),
n AS (SELECT *, list_transform(range(1, 4), lambda i: s[i] / greatest(strlen(o[i]), 1)) AS b FROM c)
SELECT p_partkey, (list_position(s, list_max(s)) - 1)::INT AS best, (list_position(b, list_max(b)) - 1)::INT AS best_norm FROM n"""
)
def choice_likelihood(spark, sf):
    choices = F.array("p_name", "p_brand", "p_type")
    scores = F.array(-1.0 * (F.col("p_size") % 7), -1.0 * (F.col("p_partkey") % 5), F.lit(-2.5))
    return _read(spark, sf, "part").select("p_partkey", score.likeliest(scores).alias("best"), score.likeliest(scores, choices).alias("best_norm"))


@query(
    """SELECT p_name || chr(10) || chr(10) || array_to_string(list_filter([CASE WHEN p_brand <> '' THEN 'A) ' || p_brand END, CASE WHEN p_partkey % 3 > 0 THEN 'B) ' || p_type END, 'C) ' || p_size, NULL],
  lambda x: x IS NOT NULL), chr(10)) || chr(10) || chr(10) || 'Answer:' AS input, (p_partkey % 5 % 4)::INT AS target FROM part WHERE p_size % 2 = 0"""
)
def four_option_task(spark, sf):
    rows = _read(spark, sf, "part").select(
        F.col("p_name").alias("question"), F.col("p_brand").alias("option1"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise("").alias("option2"),
        F.col("p_size").cast("string").alias("option3"), F.lit(None).cast("string").alias("option4"),
        F.concat(F.lit("option"), F.col("p_partkey") % 5 + 1).alias("target"), F.when(F.col("p_size") % 2 == 0, "Science").otherwise("Arts").alias("domain"),
    )
    return tasks.four_option_samples(rows)


@query(
    """WITH k AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'MCQ' WHEN 1 THEN 'Integer' END AS kind FROM orders)
SELECT o_comment_ || chr(10) || chr(10) || CASE kind WHEN 'MCQ' THEN 'Answer with a single letter (A, B, C, or D). End your response with: Final answer: <letter>'
  WHEN 'Integer' THEN 'End your response with: Final answer: <number>' ELSE 'End your response with: Final answer: <answer>' END || chr(10) AS input, o_custkey::VARCHAR AS target
FROM (SELECT *, o_orderpriority || ' ' || o_orderkey AS o_comment_ FROM k)"""
)
def open_task(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "MCQ").when(F.col("o_orderkey") % 3 == 1, "Integer")
    question = F.concat("o_orderpriority", F.lit(" "), "o_orderkey")
    gold = F.concat(F.lit(" "), "o_custkey", F.lit(" "))
    return tasks.open_samples(_read(spark, sf, "orders").select(question.alias("question"), kind.alias("type"), gold.alias("gold")))


_HINTS = {k: v.replace("'", "''") for k, v in shape.TYPE_HINT.items()}


@query(
    f"""SELECT s_suppkey::VARCHAR AS id, 'jee_main' AS exam, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE lower(s_name) END AS subject,
CASE WHEN s_suppkey % 2 = 0 THEN 'numerical' ELSE 'single_correct' END AS question_type, s_nationkey::VARCHAR AS target,
'Subject: ' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END || chr(10) || 'Question type: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'numerical' ELSE 'single_correct' END || chr(10) || chr(10) || 'Question (Hindi):' || chr(10) || s_name || chr(10)
  || CASE WHEN s_suppkey % 2 = 0 THEN '{_HINTS["numerical"]}' ELSE chr(10) || 'Options:' || chr(10) || '(A) ' || s_name || chr(10) || '{_HINTS["single_correct"]}' END
  || chr(10) || chr(10) || 'Remember: end your response with a line of the exact form ''Final answer: <answer>''.' || chr(10) AS input FROM supplier"""
)
def exam_samples(spark, sf):
    none = F.lit(None).cast("string")
    rows = _read(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), none.alias("exam"), F.lit(2026).alias("year"), none.alias("paper"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("subject"),
        F.when(F.col("s_suppkey") % 2 == 0, "numerical").alias("question_type"), F.col("s_name").alias("question"),
        F.array(F.struct(F.lit("A").alias("label"), F.col("s_name").alias("text"))).alias("options"), F.concat("s_nationkey", F.lit(" ")).alias("answer"), F.lit(None).cast("boolean").alias("has_diagram"),
    )
    return tasks.exam_samples(rows, "jee_main").select("id", "metadata.exam", "metadata.subject", "metadata.question_type", "target", "input")


# Generated solutions


@query(
    r"""WITH u AS (SELECT page_id, coalesce(url, 'unknown') AS u FROM pages), b AS (SELECT *, regexp_extract(u, '([^/]*)/*$', 1) AS b FROM u)
SELECT page_id, substr(regexp_replace(regexp_replace(b, '(?s)^(.+)\.[^.]+$', '\1'), '[^a-zA-Z0-9_\-]', '_', 'g'), 1, 60) || '_Q' || page_id AS question_id,
  CASE WHEN contains(lower(u), 'biology') THEN 'biology' WHEN contains(lower(u), 'chemistry') THEN 'chemistry' WHEN contains(lower(u), 'physics') THEN 'physics' WHEN contains(lower(u), 'math') THEN 'mathematics' ELSE 'unknown' END AS subject FROM b"""
)
def question_ids(spark, sf):
    url = F.coalesce("url", F.lit("unknown"))
    return _read(spark, sf, "pages").select("page_id", solutions.question_id(url, F.col("page_id").cast("string")).alias("question_id"), solutions.file_subject(url).alias("subject"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    f"""SELECT p_partkey, md5({_quoted(solutions.PROMPT_HEAD)} || 'QUESTION #' || p_partkey || ' | SUBJECT: ' || p_brand || ' | SECTION: A | LANGUAGE: unknown' || {_quoted(solutions.PROMPT_ANSWER)} ||
  CASE WHEN p_size % 2 = 0 THEN 'YES (not provided — use text only)' ELSE 'NO' END || chr(10) || chr(10) || '📝 QUESTION:' || chr(10) || p_name || chr(10) || chr(10) || '📋 OPTIONS:' || chr(10) ||
  CASE WHEN p_size % 3 = 0 THEN '  (no options provided)' ELSE '  (1)  ' || p_type || chr(10) || '  (2)  ' || p_brand END || chr(10) ||
  CASE WHEN p_size % 2 = 0 THEN {_quoted(solutions.DIAGRAM_NOTE)} ELSE '' END || {_quoted(solutions.PROMPT_TASK)}) AS prompt_md5 FROM part"""
)
def solver_prompts(spark, sf):
    options = F.when(F.col("p_size") % 3 != 0, F.array("p_type", "p_brand"))
    prompt = solutions.solver_prompt(F.col("p_partkey").cast("string"), F.col("p_brand"), F.lit("A"), F.lit(None), F.col("p_name"), options, F.col("p_size") % 2 == 0)
    return _read(spark, sf, "part").select("p_partkey", F.md5(prompt).alias("prompt_md5"))


def _generated(spark, sf):
    """Each document as a model's answer, some without an answer or braces, some in a fence."""
    made = F.to_json(F.struct(F.col("text").alias("solution"), F.when(F.col("doc_id") % 5 != 0, F.lit(" d, a ")).alias("answer"), F.lit("MCQ_multi").alias("answer_type"), F.col("source").alias("subject")))
    raw = F.when(F.col("doc_id") % 7 == 0, "no json").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).otherwise(made)
    none = F.lit(None).cast("string")
    rows = _docs(spark, sf).select("doc_id", F.col("text").alias("question"), none.alias("subject"), none.alias("level"), F.lit(None).cast("array<string>").alias("options"), none.alias("question_no"), F.col("source").alias("source_file"), raw.alias("raw"))
    return solutions.judged(rows, "raw")


_JUDGED = f"""judged AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'not_json' WHEN coalesce(text, '') = '' THEN 'no_solution' WHEN doc_id % 5 = 0 THEN 'no_answer'
  WHEN len({_sql_words('text')}) < 15 THEN 'too_short' END AS reason FROM documents)"""


@query(f"WITH {_JUDGED} SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'AD' END AS answer FROM judged")
def generated_acceptance(spark, sf):
    return _generated(spark, sf).select("doc_id", "reason", F.when(F.col("reason").isNull(), F.col("generated.answer")).alias("answer"))


@query(f"WITH {_JUDGED} SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS generated, count(*) FILTER (reason IS NOT NULL) AS failed, round(count(*) FILTER (reason IS NULL) / greatest(count(*), 1) * 100, 1) AS success_rate FROM judged")
def solution_summary(spark, sf):
    return solutions.summary(_generated(spark, sf))


@query(
    f"""WITH {_JUDGED}, g AS (SELECT coalesce(nullif(source, ''), 'unknown') || '_JEE_Advanced' AS grp FROM judged WHERE reason IS NULL)
SELECT 'group' AS cut, grp AS value, count(*) AS n FROM g GROUP BY grp UNION ALL SELECT 'answer_type', 'MCQ_multi', count(*) FROM g HAVING count(*) > 0"""
)
def solution_groups(spark, sf):
    return solutions.distributions(solutions.records(_generated(spark, sf).filter("reason is null")), "group", "answer_type")


@query("SELECT 'lang' AS cut, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def distributions(spark, sf):
    return solutions.distributions(_docs(spark, sf), "lang", "source")


@query(f"WITH t AS ({_turn_sql('(conv_id * 7 + turn) % 5 <> 1')}) SELECT issue, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct, issue = 'valid' AS ok FROM t GROUP BY issue")
def issue_breakdown(spark, sf):
    """Of conversations that lack turns, as in ``turn_validity_broken``."""
    turns = _read(spark, sf, "conversations").filter("(conv_id * 7 + turn) % 5 <> 1")
    return quality.issue_breakdown(quality.turn_issues(turns, "conv_id", "turn", "role"))


# Reused rows


@query(
    f"""WITH r AS (SELECT doc_id, text, doc_id % 4 = 1 AS anchored, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 2 END AS prio FROM documents WHERE coalesce(text, '') <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY sha256({_sql_hash_normal('text')}) ORDER BY prio, doc_id) AS n FROM r) SELECT doc_id FROM k WHERE anchored OR n = 1"""
)
def reused_rows(spark, sf):
    docs = _docs(spark, sf)
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("text").alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit("x").alias("value")))
    rows = policies.reused(docs.select("doc_id", turns.alias("conversations"))).filter("reason is null")
    anchored = F.col("doc_id") % 4 == 1
    return policies.with_reused(rows.select(F.when(anchored, 1).otherwise(2).alias("prio"), F.col("doc_id").alias("ord"), "question", anchored.alias("anchored"))).select(F.col("ord").alias("doc_id"))


# Near-duplicate gates


def word_embedder(size: int = 256, salt: int = 0):
    """A stand-in for a model: words are hashed to signed places of a vector and added up."""

    def call(texts: list[str]) -> list:
        out = np.zeros((len(texts), size))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode(), salt)
                row[h % size] += 1 if h & 0x8000_0000 else -1
        return list(out)

    return call


@query()
def near_dup_groups(spark, sf):
    return neardup.near_duplicates(_docs(spark, sf), "doc_id", "text", "text", word_embedder, lambda: word_embedder(512, 1)).groups

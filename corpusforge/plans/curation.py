"""Queries of the corpus builder, records and papers, chat texts, few shots, repair of answers, the cleaner and resumed work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import answers as A
from corpusforge.operators import dedup, sampling, shape, tasks
from corpusforge.plans.catalogue import _COT, _GROUPS, _KEPT, _LINES, _chance_sql, _cot, _docs, _kept, _questions, _read, _sql_collapsed, _sql_hash_normal, _sql_trim, query
from corpusforge.functions import text as T
from corpusforge.runtime import table
from corpusforge.sources import builder

# The builder

_SAID = "SELECT conv_id * 1000 + turn AS ord, text AS question FROM conversations WHERE coalesce(text, '') <> ''"


def _registry(sf: str) -> builder.Registry:
    turns = F.lit(None).cast("array<struct<`from` string, value string>>").alias("conversations")
    said = lambda spark: _read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), turns, F.col("text").alias("instruction"), F.col("text").alias("output"))
    return builder.Registry(builder.Source("D1", "math_cot", lambda spark: _cot(spark, sf), target=300), builder.Source("SYN", "synthetic", said, target=500))


def _built(spark, sf, **config) -> DataFrame:
    return builder.build(spark, _registry(sf), builder.BuildConfig(**config))[0].select("source_id", "ord", F.md5("question").alias("question_md5"))


_FIRST = f"""WITH {_COT}, a AS (SELECT ord, question, sha256({_sql_hash_normal('question')}) AS h FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY h ORDER BY ord) = 1 ORDER BY ord LIMIT 300),
said AS (SELECT *, sha256({_sql_hash_normal('question')}) AS h FROM ({_SAID})),
b AS (SELECT ord, question FROM said WHERE h NOT IN (SELECT h FROM a) QUALIFY row_number() OVER (PARTITION BY h ORDER BY ord) = 1 ORDER BY ord LIMIT 500)"""


@query(f"{_FIRST} SELECT 'D1' AS source_id, ord, md5(question) AS question_md5 FROM a UNION ALL SELECT 'SYN', ord, md5(question) FROM b")
def build_exact(spark, sf):
    return _built(spark, sf, duplicates="exact")


@query(
    f"""WITH {_COT}, a AS (SELECT ord, question FROM judged WHERE reason IS NULL ORDER BY ord LIMIT 200), b AS (SELECT * FROM ({_SAID}) ORDER BY ord LIMIT 500)
SELECT 'D1' AS source_id, ord, md5(question) AS question_md5 FROM a UNION ALL SELECT 'SYN', ord, md5(question) FROM b"""
)
def build_without_dedup(spark, sf):
    return _built(spark, sf, duplicates="off", targets={"D1": 200})


@query(f"{_FIRST}, s AS (SELECT 'D1' AS source_id, count(*) AS n FROM a UNION ALL SELECT 'SYN', count(*) FROM b) SELECT source_id, n, round(100.0 * n / sum(n) OVER (), 4)::DOUBLE AS share FROM s")
def build_report(spark, sf):
    return builder.build(spark, _registry(sf), builder.BuildConfig(duplicates="exact"))[1]


@query()
def build_near(spark, sf):
    """Tested against the loop in order on small tables."""
    return _built(spark, sf, only=("d1", "syn"), targets={"D1": 200, "SYN": 100})


# Records, papers, chat texts, shots


@query(
    """SELECT p_partkey, p_name AS question, p_type AS answer, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, 'unknown') AS source,
  CASE p_size % 3 WHEN 0 THEN 's' || p_partkey WHEN 1 THEN 'c' || p_partkey ELSE 'unknown' END AS source_chunk_id, 'unknown' AS subject, p_size % 5 AS n_concepts FROM part"""
)
def formatter_records(spark, sf):
    size, part = F.col("p_size"), F.col("p_partkey")
    rows = _read(spark, sf, "part").select(
        F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.when(size % 2 == 0, F.col("p_brand")).alias("book_title"), part.cast("string").alias("topic"),
        F.when(size % 3 == 0, F.concat(F.lit("s"), part)).alias("source_chunk_id"), F.when(size % 3 < 2, F.concat(F.lit("c"), part)).alias("chunk_id"),
        F.when(size % 5 > 0, F.array_repeat(F.lit("k"), (size % 5).cast("int"))).alias("key_concepts"),
    )
    found = shape.record(rows, F.lit("You teach."))
    turn = lambda i: F.col("conversations")[i]["value"]
    about = [F.col(f"metadata.{c}") for c in ("source", "source_chunk_id", "subject")]
    return found.select(F.col("metadata.topic").cast("long").alias("p_partkey"), turn(1).alias("question"), turn(2).alias("answer"), *about, F.size("metadata.key_concepts").cast("long").alias("n_concepts"))


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier)
SELECT s_nationkey AS paper, place::INT AS place, s_name AS question, 'p' || s_nationkey || '_' || CASE s_suppkey % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'geol' ELSE 'unkn' END || '_q' || CASE WHEN s_suppkey % 4 = 0 THEN '?' ELSE s_suppkey::VARCHAR END AS question_no,
  CASE s_suppkey % 3 WHEN 0 THEN 'mathematics' WHEN 1 THEN 'geology' ELSE 'unknown' END AS subject, CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'A' END AS section,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name || '|' END AS options, CASE WHEN s_nationkey % 2 = 0 THEN 'Hindi' ELSE 'English' END AS language FROM s"""
)
def paper_rows(spark, sf):
    key = F.col("s_suppkey")
    none = F.array().cast("array<struct<label string, text string>>")
    options = F.when(key % 5 == 0, F.lit(None)).otherwise(F.array(F.struct(F.lit("A").alias("label"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("text")), F.struct(F.lit("B").alias("label"), F.lit(None).cast("string").alias("text"))))
    question = F.struct(
        key.alias("k"), F.when(key % 4 > 0, key).alias("question_number"), F.col("s_name").alias("question_text"), F.when(key % 3 == 0, "Mathematics").when(key % 3 == 1, "Geology").alias("subject"),
        F.when(key % 2 == 0, "numerical").alias("question_type"), F.coalesce(options, F.when(key % 7 == 0, none)).alias("options"),
    )
    papers = _read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("paper")).agg(F.array_sort(F.collect_list(question)).alias("questions"))
    papers = papers.select("paper", F.lit(2025).alias("year"), F.when(F.col("paper") % 2 == 1, "English").alias("language"), F.lit("a.json").alias("source_file"), "questions")
    return shape.paper_rows(papers).select("paper", "place", "question", "question_no", "subject", "section", F.array_join("options", "|").alias("options"), "language")


@query(
    f"""WITH r AS (SELECT conv_id, turn, lower(role) AS role, {_sql_trim("coalesce(text, '')")} AS t FROM conversations)
SELECT conv_id, md5(string_agg(CASE WHEN role IN ('user', 'human') THEN '<start_of_turn>user' || chr(10) || t || '<end_of_turn>' || chr(10) WHEN role IN ('assistant', 'gpt', 'model') THEN '<start_of_turn>model' || chr(10) || t || '<end_of_turn>' || chr(10)
  WHEN role = 'system' THEN '<start_of_turn>system' || chr(10) || t || '<end_of_turn>' || chr(10) ELSE t || chr(10) END, '' ORDER BY turn)) AS text_md5 FROM r GROUP BY conv_id"""
)
def chat_texts(spark, sf):
    convs = shape.gather_turns(_read(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    return convs.select("conv_id", F.md5(shape.rendered(turns)).alias("text_md5"))


@query(
    f"""{_LINES}, p AS (SELECT p_partkey, question || chr(10) || chr(10) || array_to_string(list_transform(ls, lambda x: x || ') ' || trim(o[instr('ABCD', x)])), chr(10)) || chr(10) || chr(10) || 'Answer:' AS input, answer FROM l),
s AS (SELECT string_agg(input || ' ' || answer || chr(10) || chr(10), '' ORDER BY p_partkey) AS shown FROM (SELECT * FROM p WHERE p_partkey % 2 = 0 ORDER BY p_partkey LIMIT 3))
SELECT p_partkey, md5(shown || input) AS input_md5 FROM p, s WHERE p_partkey % 2 = 1"""
)
def few_shot_prompts(spark, sf):
    q = _questions(spark, sf)
    samples = q.select("p_partkey", shape.mcq_prompt(F.col("question"), F.col("options")).alias("input"), F.upper("answer").alias("target"))
    return tasks.with_shots(samples.filter("p_partkey % 2 = 1"), samples.filter("p_partkey % 2 = 0"), 3, "p_partkey").select("p_partkey", F.md5("input").alias("input_md5"))


# Repair of blank answers


def _to_repair(spark, sf) -> DataFrame:
    """Orders as questions: some have an answer, of the others some solutions conclude one."""
    key = F.col("o_orderkey")
    kind = F.when(key % 2 == 0, "numerical").otherwise("mcq_single")
    solution = F.when(key % 5 == 0, "no conclusion").when(key % 2 == 0, F.concat(F.lit("Hence \\boxed{"), key, F.lit("}"))).otherwise(F.concat(F.lit("the correct option is ("), key % 4 + 1, F.lit(")")))
    answer = F.when(key % 3 == 0, "given").when(key % 3 == 1, " ")
    rows = _read(spark, sf, "orders").select("o_orderkey", kind.alias("answer_type"), answer.alias("answer"), solution.alias("solution"))
    return rows.withColumn("boxes", A.boxed("solution"))


_REPAIRED = """WITH r AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS num, o_orderkey % 3 = 0 AS given, o_orderkey % 5 > 0 AS found FROM orders)"""


@query(
    f"""{_REPAIRED} SELECT o_orderkey, CASE WHEN given THEN 'given' WHEN found AND num THEN o_orderkey::VARCHAR WHEN found THEN substr('ABCD', (o_orderkey % 4 + 1)::INT, 1)
  WHEN o_orderkey % 3 = 1 THEN ' ' END AS answer FROM r"""
)
def repaired_answers(spark, sf):
    rows = _to_repair(spark, sf)
    return rows.select("o_orderkey", A.repaired_answer(F.col("answer"), F.col("solution"), F.col("answer_type"), F.col("boxes")).alias("answer"))


@query(f"{_REPAIRED} SELECT CASE WHEN num THEN 'numerical' ELSE 'mcq_single' END AS answer_type, count(*) AS blank, count(*) FILTER (found) AS extracted, count(*) FILTER (NOT found) AS failed FROM r WHERE NOT given GROUP BY 1")
def repair_report(spark, sf):
    return A.repair_report(_to_repair(spark, sf))


# The cleaner

_CLOSE = """SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45"""
_CLEANER = f"""exact AS (SELECT min(doc_id) OVER (PARTITION BY md5({_sql_collapsed('text')})) AS i, doc_id AS j FROM documents),
pairs AS MATERIALIZED (SELECT i, j FROM exact WHERE j > i UNION SELECT i, j FROM ({_CLOSE}) WHERE i IN (SELECT doc_id FROM documents) AND j IN (SELECT doc_id FROM documents))"""


def _cleaner(spark, sf) -> DataFrame:
    """Edges of equal texts and of close vectors, the vector of a document being that of its id."""
    docs = _docs(spark, sf)
    exact = dedup.star_pairs(docs, F.md5(T.lower_collapsed(F.col("text"))), "doc_id")
    vectors = _read(spark, sf, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return table(dedup.cleaner_edges(exact, dedup.cosine_pairs(vectors, "vec_id", "embedding", 0.4), 0.45), "cleaner-edges")


@query(f"WITH {_CLEANER} SELECT i, j FROM pairs")
def cleaner_edges(spark, sf):
    return _cleaner(spark, sf)


@query(f"WITH RECURSIVE {_CLEANER}, {_GROUPS}, {_KEPT} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM members JOIN kept USING (group_id) WHERE id <> keep)")
def cleaned(spark, sf):
    members = table(dedup.groups(_cleaner(spark, sf)), "groups")
    return dedup.without(_docs(spark, sf), "doc_id", members, _kept(spark, sf, members)).select("doc_id")


# Orders


@query(f"SELECT doc_id, (row_number() OVER (ORDER BY {_chance_sql('doc_id')}, doc_id) - 1)::BIGINT AS position FROM documents")
def shuffled(spark, sf):
    rows = _docs(spark, sf).select("doc_id", sampling.chance("doc_id").alias("c"))
    return sampling.numbered(rows, "c", "doc_id").select("doc_id", "position")


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, lang, doc_id) - 1)::BIGINT AS position FROM documents")
def sorted_rows(spark, sf):
    return sampling.numbered(_docs(spark, sf).select("doc_id", "source", "lang"), "source", "lang", "doc_id").select("doc_id", "position")


@query("SELECT doc_id, source FROM documents WHERE source IS NOT NULL ORDER BY doc_id LIMIT 50")
def head_rows(spark, sf):
    return sampling.head(_docs(spark, sf).select("doc_id", "source").filter("source is not null"), 50, "doc_id")

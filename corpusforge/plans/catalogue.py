"""Registry of the library's queries, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import answers as A
from corpusforge.functions import text as T
from corpusforge.operators import dedup as D
from corpusforge.operators import quality, sampling, score, sequence, shape
from corpusforge.runtime import table
from corpusforge.sources import policies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WS = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+"


def _sql_words(t: str) -> str:
    return f"list_filter(string_split_regex(coalesce({t}, ''), '{_WS}'), lambda w: w <> '')"


def _sql_trim(t: str) -> str:
    return rf"regexp_replace({t}, '^{_WS}|{_WS}$', '', 'g')"


def _sql_collapsed(t: str) -> str:
    return _sql_trim(f"regexp_replace(lower(coalesce({t}, '')), '{_WS}', ' ', 'g')")


def _sql_hash_normal(t: str) -> str:
    return rf"regexp_replace({_sql_collapsed(t)}, '[^\p{{L}}\p{{N}}_ ]', '', 'g')"


def _sql_semantic(t: str) -> str:
    out = _sql_collapsed(t)
    for pattern, new in T.SEMANTIC_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents")


# Texts


@query(f"SELECT doc_id, len({_sql_words('text')})::INT AS n_words FROM documents WHERE len({_sql_words('text')}) BETWEEN 50 AND 3000")
def word_count_gate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("n_words")).filter("n_words between 50 and 3000")


@query(f"SELECT doc_id, md5({_sql_semantic('text')}) AS normal_md5 FROM documents")
def semantic_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.semantic_normal(F.col("text"))).alias("normal_md5"))


@query(
    f"""WITH t AS (SELECT doc_id, list_filter(string_split({_sql_semantic('text')}, ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, len(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))))::INT AS n_shingles FROM t"""
)
def shingle_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles"))


# Exact duplicates


@query(f"SELECT doc_id, h AS hash FROM (SELECT doc_id, sha256({_sql_hash_normal('text')}) AS h FROM documents) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1")
def exact_dedup_first_wins(spark, sf):
    hashed = _docs(spark, sf).select("doc_id", F.sha2(T.hash_normal(F.col("text")), 256).alias("hash"))
    return D.first_wins(hashed, F.col("hash"), "doc_id")


@query(f"WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5({_sql_collapsed('text')})) AS i FROM documents) SELECT i, doc_id AS j FROM k WHERE doc_id > i")
def exact_pairs_star(spark, sf):
    return D.star_pairs(_docs(spark, sf), F.md5(T.lower_collapsed(F.col("text"))), "doc_id")


# Similar documents: pairs are between representatives of equal word sets

_WORD_SETS = f"""sets AS (SELECT doc_id, list_sort(list_distinct({_sql_words("lower(coalesce(text, ''))")})) AS s FROM documents),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets GROUP BY s),
posts AS MATERIALIZED (SELECT c, n, unnest(s) AS w FROM classes),
shared AS MATERIALIZED (SELECT a.c AS i, b.c AS j, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM posts a JOIN posts b ON a.w = b.w AND a.c < b.c GROUP BY a.c, b.c)"""


def _word_classes(spark, sf) -> tuple[DataFrame, DataFrame]:
    return D.token_classes(_docs(spark, sf), "doc_id", T.words(F.lower(T.text("text"))))


@query(f"WITH {_WORD_SETS} SELECT doc_id, c AS class_id FROM sets JOIN classes USING (s)")
def word_set_classes(spark, sf):
    return _word_classes(spark, sf)[0].select(F.col("id").alias("doc_id"), "class_id")


@query(f"WITH {_WORD_SETS} SELECT i, j, CASE WHEN k::DOUBLE / (na + nb - k) >= 0.8 THEN 'confirmed' ELSE 'borderline' END AS tier FROM shared WHERE k::DOUBLE / (na + nb - k) >= 0.6")
def jaccard_tiers(spark, sf):
    return D.tiers(D.set_similarity_pairs(_word_classes(spark, sf)[1], 0.6), 0.8, 0.6).select("i", "j", "tier")


@query(f"WITH {_WORD_SETS} SELECT i, j FROM shared WHERE k::DOUBLE / least(na, nb) >= 0.9")
def containment_pairs(spark, sf):
    return D.set_similarity_pairs(_word_classes(spark, sf)[1], 0.9, "containment").select("i", "j")


@query(f"WITH {_WORD_SETS} SELECT i, j FROM shared WHERE k::DOUBLE / (na + nb - k) >= 0.8")
def minhash_pairs(spark, sf):
    """Pairs that the bands find, against all pairs: the SQL's rows are there but for a chance of 0.00005 each."""
    return D.minhash_pairs(_word_classes(spark, sf)[1], 0.8).select("i", "j")


_SEMANTIC = f"""t AS (SELECT doc_id, list_filter(string_split({_sql_semantic('text')}, ' '), lambda w: w <> '') AS w, {_sql_hash_normal('text')} AS h FROM documents),
g AS (SELECT doc_id, h, list_sort(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))))) AS s FROM t),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [chr(10) || h] END AS s FROM g),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets GROUP BY s),
posts AS MATERIALIZED (SELECT c, n, unnest(s) AS w FROM classes),
edges AS MATERIALIZED (SELECT a.c AS i, b.c AS j FROM posts a JOIN posts b ON a.w = b.w AND a.c < b.c GROUP BY a.c, b.c
  HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8 OR count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) >= 0.9)"""


@query(
    f"""WITH RECURSIVE {_SEMANTIC}, late AS MATERIALIZED (SELECT j, list(i) AS earlier, row_number() OVER (ORDER BY j) AS k FROM edges GROUP BY j),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT late.k, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, j) ELSE gone END FROM walk JOIN late ON late.k = walk.k + 1),
rejected AS (SELECT unnest(gone) AS c FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1))
SELECT doc_id, doc_id = classes.c AND classes.c NOT IN (SELECT c FROM rejected) AS accepted FROM sets JOIN classes USING (s)"""
)
def first_wins_near_dedup(spark, sf):
    """Duplicates have a Jaccard of 0.8 or a containment of 0.9 of their semantic shingles; texts without any are only compared as a whole."""
    members, classes = D.token_classes(_docs(spark, sf), "doc_id", T.shingle_words(F.col("text")), grams=3)
    edges = D.set_similarity_pairs(classes, 0.8, grams=3, contained=0.9).select("i", "j")
    decided = D.accept_first(classes.select(F.col("class_id").alias("id")), edges)
    return members.join(decided.withColumnRenamed("id", "class_id"), "class_id").select(F.col("id").alias("doc_id"), (F.col("accepted") & (F.col("id") == F.col("class_id"))).alias("accepted"))


_PAIRS = f"""{_WORD_SETS},
pairs AS MATERIALIZED (SELECT c AS i, doc_id AS j, 'exact_hash' AS label FROM sets JOIN classes USING (s) WHERE doc_id > c
  UNION ALL SELECT i, j, 'wordllama_jaccard' FROM shared WHERE k::DOUBLE / (na + nb - k) >= 0.6)"""
_GROUPS = """sym AS MATERIALIZED (SELECT i AS a, j AS b FROM pairs UNION SELECT j, i FROM pairs),
reach AS (SELECT DISTINCT a AS id, a AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON reach.r = sym.a),
members AS MATERIALIZED (SELECT id, min(r) AS group_id FROM reach GROUP BY id)"""
_KEPT = "kept AS MATERIALIZED (SELECT group_id, arg_max(id, (length(text), -id)) AS keep, count(*) AS size FROM members JOIN documents ON doc_id = id GROUP BY group_id)"


def _similar(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Labelled pairs (stars of equal word sets, similar representatives) and group members."""
    members, classes = _word_classes(spark, sf)
    exact = members.filter("id > class_id").select(F.col("class_id").alias("i"), F.col("id").alias("j"), F.lit("exact_hash").alias("label"))
    near = D.set_similarity_pairs(classes, 0.6).select("i", "j", F.lit("wordllama_jaccard").alias("label"))
    pairs = table(D.label_pairs(exact, near), "labelled-pairs")
    return pairs, table(D.groups(pairs), "groups")


def _kept(spark, sf, members: DataFrame) -> DataFrame:
    return D.keep_longest(members, _docs(spark, sf).select(F.col("doc_id").alias("id"), F.char_length("text").alias("length")))


@query(f"WITH RECURSIVE {_PAIRS}, {_GROUPS} SELECT id AS doc_id, group_id FROM members")
def dup_components(spark, sf):
    return _similar(spark, sf)[1].select(F.col("id").alias("doc_id"), "group_id")


@query(f"WITH RECURSIVE {_PAIRS}, {_GROUPS}, {_KEPT} SELECT group_id, keep, size FROM kept")
def keep_longest(spark, sf):
    return _kept(spark, sf, _similar(spark, sf)[1])


@query(f"WITH RECURSIVE {_PAIRS}, {_GROUPS}, {_KEPT} SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id NOT IN (SELECT id FROM members JOIN kept USING (group_id) WHERE id <> keep)")
def dup_clean(spark, sf):
    members = _similar(spark, sf)[1]
    return D.without(_docs(spark, sf), "doc_id", members, _kept(spark, sf, members)).select("doc_id", F.md5("text").alias("text_md5"))


_CONFIDENCE = "conf AS (SELECT group_id, min(label) AS confidence, count(DISTINCT id) AS size FROM members LEFT JOIN pairs ON i = id GROUP BY group_id)"


@query(f"WITH RECURSIVE {_PAIRS}, {_GROUPS}, {_CONFIDENCE} SELECT group_id, confidence FROM conf")
def dup_confidence(spark, sf):
    pairs, members = _similar(spark, sf)
    return D.group_confidence(members, pairs)


@query(f"WITH RECURSIVE {_PAIRS}, {_GROUPS}, {_CONFIDENCE} SELECT confidence, sum(size - 1)::BIGINT AS removed, count(*) AS n_groups FROM conf GROUP BY confidence")
def removed_by_gate(spark, sf):
    pairs, members = _similar(spark, sf)
    sizes = members.groupBy("group_id").agg(F.count("*").alias("size"))
    return D.group_confidence(members, pairs).join(sizes, "group_id").groupBy("confidence").agg(F.sum(F.col("size") - 1).alias("removed"), F.count("*").alias("n_groups"))


_COSINE = "SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id {0} WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4"


@query(_COSINE.format(""))
def cosine_pairs(spark, sf):
    return D.cosine_pairs(_read(spark, sf, "embeddings"), "vec_id", "embedding", 0.4).select("i", "j")


@query(_COSINE.format("AND a.vec_id // 100 <> b.vec_id // 100"))
def cosine_pairs_blocked(spark, sf):
    return D.cosine_pairs(_read(spark, sf, "embeddings"), "vec_id", "embedding", 0.4, across_only=100).select("i", "j")


# Conversations

_ROLE = "CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('assistant', 'gpt', 'model') THEN 'assistant' ELSE lower(role) END"


def _turn_sql(where: str) -> str:
    return f"""WITH r AS (SELECT conv_id, turn, {_ROLE} AS r FROM conversations WHERE {where}),
s AS (SELECT *, lag(r) OVER w AS b, row_number() OVER w AS k FROM r WHERE r <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT conv_id, k, CASE WHEN k = 1 AND r <> 'user' THEN 'starts_with_' || r WHEN r = b THEN 'consecutive_' || r END AS issue FROM s),
f AS (SELECT conv_id, arg_min(issue, k) FILTER (issue IS NOT NULL) AS issue FROM i GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN f.conv_id IS NULL THEN 'empty' ELSE coalesce(issue, 'valid') END AS issue FROM (SELECT DISTINCT conv_id FROM r) c LEFT JOIN f USING (conv_id)"""


@query(_turn_sql("true"))
def turn_validity(spark, sf):
    return quality.turn_issues(_read(spark, sf, "conversations"), "conv_id", "turn", "role")


@query(_turn_sql("(conv_id * 7 + turn) % 5 <> 1"))
def turn_validity_broken(spark, sf):
    """The linter on conversations that lack turns: the made ones are all in order, so every fifth turn is left out to break them."""
    return quality.turn_issues(_read(spark, sf, "conversations").filter("(conv_id * 7 + turn) % 5 <> 1"), "conv_id", "turn", "role")


@query(
    f"""SELECT conv_id, md5(coalesce(arg_min(text, turn) FILTER ({_ROLE} = 'user'), '')) AS question_md5, md5(coalesce(arg_min(text, turn) FILTER ({_ROLE} = 'assistant'), '')) AS answer_md5,
  coalesce(length(arg_min(text, turn) FILTER ({_ROLE} = 'assistant')), 0)::INT AS answer_length FROM conversations GROUP BY conv_id"""
)
def first_qa(spark, sf):
    convs = shape.gather_turns(_read(spark, sf, "conversations"), "conv_id", "turn", "role", "text").withColumn("turns", shape.from_messages(F.col("messages")))
    q, a = shape.first_turn(F.col("turns"), "human"), shape.first_turn(F.col("turns"), "gpt")
    return convs.select("conv_id", F.md5(q).alias("question_md5"), F.md5(a).alias("answer_md5"), F.char_length(a).alias("answer_length"))


@query(f"SELECT conv_id, md5(arg_max(text, turn) FILTER ({_ROLE} = 'assistant' AND text <> '')) AS answer_md5 FROM conversations GROUP BY conv_id")
def last_assistant(spark, sf):
    convs = shape.gather_turns(_read(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return convs.select("conv_id", F.md5(shape.last_assistant(F.col("messages"))).alias("answer_md5"))


@query("SELECT item_id, 0 AS pos, 'human' AS who, 'Q' || item_id AS value FROM benchmark UNION ALL SELECT item_id, 1, 'gpt', text FROM benchmark")
def to_conversation(spark, sf):
    convs = _read(spark, sf, "benchmark").select("item_id", F.posexplode(shape.conversation(F.concat(F.lit("Q"), "item_id"), F.col("text"))).alias("pos", "t"))
    return convs.select("item_id", "pos", F.col("t.from").alias("who"), F.col("t.value").alias("value"))


@query(
    f"""WITH r AS (SELECT conv_id, turn, CASE {_ROLE} WHEN 'user' THEN 'human' ELSE 'gpt' END AS who, text FROM conversations WHERE {_ROLE} IN ('user', 'assistant') AND trim(text) <> '')
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, who, md5(text) AS value_md5 FROM r"""
)
def message_conversations(spark, sf):
    convs = shape.gather_turns(_read(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return convs.select("conv_id", F.posexplode(shape.from_messages(F.col("messages"))).alias("pos", "t")).select("conv_id", "pos", F.col("t.from").alias("who"), F.md5("t.value").alias("value_md5"))


# Samples and limits


def _chance_sql(key: str) -> str:
    return f"md5('42:' || {key})"


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def source_cap(spark, sf):
    return sampling.cap_per_group(_docs(spark, sf).select("doc_id", "source"), "source", 20, "doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {_chance_sql('doc_id')}, doc_id LIMIT 100")
def sample_n(spark, sf):
    return sampling.sample_n(_docs(spark, sf).select("doc_id"), 100, "doc_id")


@query(
    f"""WITH d AS (SELECT doc_id, len({_sql_words('text')}) AS w FROM documents), h AS (SELECT doc_id FROM d ORDER BY w DESC, doc_id LIMIT 70)
SELECT doc_id FROM h UNION ALL (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h) ORDER BY {_chance_sql('doc_id')}, doc_id LIMIT 30)"""
)
def hard_biased_sample(spark, sf):
    return sampling.hard_biased(_docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("w")), 100, "w", "doc_id").select("doc_id")


@query(
    f"""WITH r AS (SELECT doc_id, lang, {_chance_sql('doc_id')} AS c, row_number() OVER (PARTITION BY lang ORDER BY {_chance_sql('doc_id')}, doc_id) AS k, (SELECT count(DISTINCT lang) FROM documents) AS g FROM documents)
SELECT doc_id, lang FROM r ORDER BY k > greatest(1, 102 // g), c, doc_id LIMIT 102"""
)
def balanced_sample(spark, sf):
    return sampling.balanced(_docs(spark, sf).select("doc_id", "lang"), 102, "lang", "doc_id")


@query(
    """WITH a AS (SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 250)
SELECT doc_id FROM a UNION ALL (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 500 - (SELECT count(*) FROM a))"""
)
def split_quota(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "lang")
    return sampling.split_quota(docs.filter("lang = 'de'").select("doc_id"), docs.filter("lang = 'en'").select("doc_id"), 500, "doc_id")


# Reports


def _first_wins_union(spark, sf) -> DataFrame:
    docs = _docs(spark, sf).filter(T.word_count(F.col("text")).between(50, 3000)).select(F.lit(0).alias("prio"), F.col("doc_id").alias("ord"), "source", "text")
    said = _read(spark, sf, "conversations").select(F.lit(1).alias("prio"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.lit("conversations").alias("source"), "text")
    bench = _read(spark, sf, "benchmark").select(F.lit(2).alias("prio"), F.col("item_id").alias("ord"), F.lit("benchmark").alias("source"), "text")
    hashed = docs.unionByName(said).unionByName(bench).select("prio", "ord", "source", F.sha2(T.hash_normal(F.col("text")), 256).alias("h"))
    return D.first_wins(hashed, F.col("h"), "prio", "ord", "source")


_UNION = f"""u AS (SELECT 0 AS prio, doc_id AS ord, source, text FROM documents WHERE len({_sql_words('text')}) BETWEEN 50 AND 3000
  UNION ALL SELECT 1, conv_id * 1000 + turn, 'conversations', text FROM conversations UNION ALL SELECT 2, item_id, 'benchmark', text FROM benchmark),
kept AS (SELECT prio, ord, source FROM u QUALIFY row_number() OVER (PARTITION BY sha256({_sql_hash_normal('text')}) ORDER BY prio, ord, source) = 1)"""


@query(f"WITH {_UNION} SELECT prio, ord, source FROM kept")
def priority_union_dedup(spark, sf):
    return _first_wins_union(spark, sf).select("prio", "ord", "source")


@query(f"WITH {_UNION} SELECT source, count(*) AS n, round(100.0 * count(*) / greatest((SELECT count(*) FROM kept), 1), 4) AS share FROM kept GROUP BY source")
def merge_report(spark, sf):
    counts = _first_wins_union(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    whole = counts.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("source", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 5")
def top_sources(spark, sf):
    return _docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("f")).orderBy(F.desc("n"), "f").limit(5).select("source", "n")


@query(
    f"""WITH w AS (SELECT len({_sql_words('text')}) AS n FROM documents)
SELECT CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'too_short' WHEN n > 3000 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n FROM w GROUP BY 1"""
)
def reject_reasons(spark, sf):
    return _docs(spark, sf).select(F.coalesce(quality.word_gate(F.col("text"), 50, 3000), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH q AS (SELECT doc_id, repeat('word ', doc_id % 12) AS question, text AS answer, CASE doc_id % 5 WHEN 0 THEN 'Numerical' WHEN 1 THEN 'true_false question' WHEN 2 THEN 'essay' WHEN 3 THEN '' ELSE 'step' END AS kind FROM documents),
n AS (SELECT *, len({_sql_words('question')}) AS qw, len({_sql_words('answer')}) AS aw, lower(trim(kind)) AS k FROM q)
SELECT doc_id, CASE WHEN question = '' THEN 'missing field: question' WHEN kind = '' THEN 'missing field: type' WHEN k = 'essay' THEN 'invalid type: essay' WHEN qw < 8 THEN 'question too short: ' || qw || ' words (min 8)' WHEN aw < 20 THEN 'answer too short: ' || aw || ' words (min 20)'
  WHEN aw > 1500 THEN 'answer too long: ' || aw || ' words (max 1500)' END AS reason,
  CASE k WHEN 'numerical' THEN 'numerical' WHEN 'true_false question' THEN 'true_false' WHEN 'step' THEN 'multi_step' WHEN '' THEN 'conceptual' END AS type FROM n"""
)
def format_length_gates(spark, sf):
    kinds = F.array(*map(F.lit, ("Numerical", "true_false question", "essay", "", "step")))
    qa = _docs(spark, sf).select("doc_id", F.repeat(F.lit("word "), (F.col("doc_id") % 12).cast("int")).alias("question"), F.col("text").alias("answer"), F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("kind"))
    reason = F.coalesce(quality.format_reason(F.col("question"), F.col("answer"), F.col("kind")), quality.length_reason(F.col("question"), F.col("answer")))
    return qa.select("doc_id", reason.alias("reason"), quality.resolved_type(F.col("kind")).alias("type"))


_LENGTHS = f"SELECT len({_sql_words('text')}) AS n FROM documents"
_STATS = f"""SELECT count(*) AS n, min(n)::BIGINT AS min, floor(quantile_cont(n, 0.5))::BIGINT AS median, round(avg(n), 2) AS mean, floor(quantile_cont(n, 0.9))::BIGINT AS p90,
  floor(quantile_cont(n, 0.95))::BIGINT AS p95, floor(quantile_cont(n, 0.99))::BIGINT AS p99, max(n)::BIGINT AS max FROM ({_LENGTHS})"""


@query(_STATS)
def length_stats(spark, sf):
    return sequence.length_stats(_docs(spark, sf).select(T.word_count(F.col("text")).alias("n")), "n")


@query(f"WITH s AS ({_STATS}) SELECT coalesce((SELECT min(b) FROM (VALUES {', '.join(f'({b})' for b in sequence.BUCKETS)}) t(b) WHERE b >= greatest(p95, p99)), max)::BIGINT AS suggested FROM s")
def suggest_len(spark, sf):
    return length_stats(spark, sf).select(sequence.suggested_length(F.col("p95"), F.col("p99"), F.col("max")).alias("suggested"))


# Questions from parts and suppliers

_OPTIONS = "[p_brand, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type END, 'size ' || p_size, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END]"


def _questions(spark, sf) -> DataFrame:
    parts = _read(spark, sf, "part")
    options = F.array("p_brand", F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_type")), F.concat(F.lit("size "), "p_size"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")))
    letter = F.substring(F.lit("abcd"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    return parts.select("p_partkey", "p_size", F.concat(F.lit(" Which is "), "p_name", F.lit("? ")).alias("question"), options.alias("options"), letter.alias("answer"))


_LINES = f"""WITH q AS (SELECT p_partkey, p_size, trim('Which is ' || p_name || '?') AS question, {_OPTIONS} AS o, substr('ABCD', (p_partkey % 4 + 1)::INT, 1) AS answer FROM part),
l AS (SELECT *, list_filter(list_transform(range(1, 5), lambda i: CASE WHEN trim(coalesce(o[i], '')) <> '' THEN substr('ABCD', i::INT, 1) END), lambda x: x IS NOT NULL) AS ls FROM q)"""


@query(f"{_LINES} SELECT p_partkey, question || chr(10) || chr(10) || array_to_string(list_transform(ls, lambda x: x || ') ' || trim(o[instr('ABCD', x)])), chr(10)) || chr(10) || chr(10) || 'Answer:' AS prompt FROM l")
def mcq_prompt(spark, sf):
    return _questions(spark, sf).select("p_partkey", shape.mcq_prompt(F.col("question"), F.col("options")).alias("prompt"))


@query(f"{_LINES} SELECT p_partkey, array_to_string(ls, '') AS letters, (CASE WHEN list_contains(ls, answer) THEN list_position(ls, answer) - 1 ELSE p_size END)::INT AS target FROM l")
def option_index(spark, sf):
    q = _questions(spark, sf)
    return q.select("p_partkey", F.array_join(shape.surviving_letters(F.col("options")), "").alias("letters"), shape.target_index(F.col("options"), F.col("answer"), F.col("p_size")).alias("target"))


@query(
    """SELECT s_suppkey, 'p1_' || CASE s_nationkey % 4 WHEN 0 THEN 'math' WHEN 1 THEN 'phys' WHEN 2 THEN 'geol' ELSE 'unkn' END || '_q' || s_suppkey AS question_no,
  CASE s_nationkey % 4 WHEN 0 THEN 'mathematics' WHEN 1 THEN 'physics' WHEN 2 THEN 'geology' ELSE 'unknown' END AS subject,
  CASE s_suppkey % 3 WHEN 0 THEN 'numerical' WHEN 1 THEN 'multi_correct' ELSE 'single_correct' END AS question_type, CASE s_suppkey % 3 WHEN 0 THEN 'B' ELSE 'A' END AS section FROM supplier"""
)
def exam_rows(spark, sf):
    subject = F.get(F.array(F.lit("Mathematics"), F.lit("PHYSICS"), F.lit("Geology"), F.lit("")), F.col("s_nationkey") % 4)
    kind = F.get(F.array(F.lit("numerical"), F.lit("multi_correct"), F.lit(None)), (F.col("s_suppkey") % 3).cast("int"))
    return _read(spark, sf, "supplier").select("s_suppkey", *shape.exam_row(F.lit("1"), F.col("s_suppkey").cast("string"), subject, kind))


# Responses from line items, and their scores

_ITEM = "l_orderkey, l_linenumber"


def _responses(spark, sf) -> DataFrame:
    """Keys, a response whose last line has the answer, and golds by type."""
    items = _read(spark, sf, "lineitem")
    n = (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("n")
    items = items.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", n)
    letter = F.substring(F.lit("ABCD"), F.col("n") % 4 + 1, F.lit(1))
    pair = F.concat(letter, F.lit(", "), F.substring(F.lit("BCDA"), F.col("n") % 4 + 1, F.lit(1)))
    number = F.concat(F.lit("$\\frac{"), "n", F.lit("}{4}$"))
    kind = F.get(F.array(F.lit("single_correct"), F.lit("multi_correct"), F.lit("numerical"), F.lit("other")), F.col("n") % 4)
    value = F.when(kind == "single_correct", letter).when(kind == "multi_correct", pair).otherwise(number)
    gold = F.when(kind == "single_correct", F.when(F.col("l_linenumber") % 2 == 0, " a").otherwise("B")).when(kind == "multi_correct", F.when(F.col("l_linenumber") % 2 == 0, "CB").otherwise("AB"))
    gold = gold.otherwise(F.concat(F.col("n") + F.col("l_linenumber") % 2, F.lit("/4")))
    response = F.concat(F.lit("Final answer: 9\nso\nFinal  Answer = "), value, F.lit("\nend"))
    return items.select("l_orderkey", "l_linenumber", "l_returnflag", "n", kind.alias("kind"), value.alias("value"), gold.alias("gold"), response.alias("response"))


_RESPONSES = r"""WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_quantity::INT + l_linenumber) AS n FROM lineitem),
r AS (SELECT *, n % 4 AS k, CASE n % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B, C' ELSE '$\frac{' || n || '}{4}$' END AS value,
  CASE n % 4 WHEN 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN ' a' ELSE 'B' END WHEN 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'CB' ELSE 'AB' END ELSE (n + l_linenumber % 2) || '/4' END AS gold FROM i),
s AS (SELECT *, CASE k WHEN 0 THEN 'single_correct' WHEN 1 THEN 'multi_correct' WHEN 2 THEN 'numerical' ELSE 'other' END AS kind,
  CASE k WHEN 0 THEN (upper(trim(gold)) = 'A')::INT WHEN 1 THEN (gold = 'CB')::INT WHEN 2 THEN (abs(n / 4.0 - (n + l_linenumber % 2) / 4.0) <= 0.01 * greatest((n + l_linenumber % 2) / 4.0, 1))::INT ELSE 0 END AS score FROM r)"""


@query(f"{_RESPONSES} SELECT {_ITEM}, value AS span FROM s")
def final_span(spark, sf):
    return _responses(spark, sf).select("l_orderkey", "l_linenumber", A.final_span(F.col("response")).alias("span"))


@query(f"{_RESPONSES} SELECT {_ITEM}, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'ABCD' ELSE '' END AS letters FROM s WHERE k < 2 UNION ALL SELECT {_ITEM}, 'AC' FROM s WHERE k >= 2")
def letter_sets(spark, sf):
    value = F.when(F.col("n") % 4 >= 2, F.lit("c, a (x)")).when(F.col("n") % 4 == 1, F.lit("b and c")).otherwise(F.col("value"))
    return _responses(spark, sf).select("l_orderkey", "l_linenumber", T.letters(value).alias("letters"))


@query(f"{_RESPONSES} SELECT {_ITEM}, CASE WHEN k < 2 THEN '' ELSE n || '/4' END AS number, CASE WHEN k >= 2 THEN n / 4.0 END::DOUBLE AS parsed FROM s")
def last_number(spark, sf):
    number = T.last_number(F.col("value"))
    return _responses(spark, sf).select("l_orderkey", "l_linenumber", number.alias("number"), T.to_float(number).alias("parsed"))


@query(f"{_RESPONSES} SELECT {_ITEM}, trim(CASE WHEN k < 2 THEN value ELSE n || '/4' END) AS flat FROM s")
def latex_flatten(spark, sf):
    boxed = F.concat(F.lit("\\boxed{\\text{"), "value", F.lit("}}"))
    plain = F.when(F.col("n") % 4 < 2, boxed).otherwise(F.col("value"))
    return _responses(spark, sf).select("l_orderkey", "l_linenumber", F.trim(T.latex_flat(plain)).alias("flat"))


@query(f"SELECT {_ITEM}, CASE l_linenumber % 5 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity / 8 WHEN 2 THEN l_quantity * pi() / 4 WHEN 3 THEN sqrt(l_quantity) ELSE l_quantity * 1000 END AS value FROM lineitem")
def numeric_parse(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    forms = [F.concat(q, F.lit("%")), F.concat(F.lit("\\frac{"), q, F.lit("}{8}")), F.concat(q, F.lit("\\pi/4")), F.concat(F.lit("\\sqrt{"), q, F.lit("}")), F.concat(q, F.lit(" \\times 10^{3}"))]
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.rich_number(F.get(F.array(*forms), F.col("l_linenumber") % 5)).alias("value"))


def _scored(name: str, kind: str, f: Callable[[Column, Column], Column]) -> None:
    def run(spark, sf):
        return _responses(spark, sf).filter(F.col("kind") == kind).select("l_orderkey", "l_linenumber", f(F.col("response"), F.col("gold")).cast("int").alias("score"))

    run.__name__ = name
    query(f"{_RESPONSES} SELECT {_ITEM}, score FROM s WHERE kind = '{kind}'")(run)


_scored("score_single", "single_correct", score.single_correct)
_scored("score_multi", "multi_correct", score.multi_correct)
_scored("score_numeric", "numerical", score.numeric)


@query(f"{_RESPONSES} SELECT {_ITEM}, kind, score FROM s")
def score_jee_mixed(spark, sf):
    return _responses(spark, sf).select("l_orderkey", "l_linenumber", "kind", score.by_type(F.col("kind"), F.col("response"), F.col("gold")).alias("score"))


@query(
    f"""{_RESPONSES} SELECT {_ITEM}, (CASE WHEN k = 0 THEN upper(trim(gold)) = 'A' WHEN k = 1 THEN gold = 'CB' ELSE false END)::INT AS score FROM s WHERE k < 2
UNION ALL SELECT {_ITEM}, (abs(n - (n + l_linenumber % 2)) < 0.01 * greatest(n + l_linenumber % 2, 1))::INT FROM s WHERE k >= 2"""
)
def score_open(spark, sf):
    numeric = F.col("n") % 4 >= 2
    response = F.when(numeric, F.concat(F.lit("first 7 then final answer: "), "n")).otherwise(F.lower(F.regexp_replace("value", ", ", ",")))
    gold = F.when(numeric, (F.col("n") + F.col("l_linenumber") % 2).cast("string")).otherwise(F.col("gold"))
    return _responses(spark, sf).select("l_orderkey", "l_linenumber", score.open_score(response, gold).alias("score"))


@query("SELECT o_orderkey, (upper(trim(o_orderstatus)) = upper(trim(substr(' f o ', (o_orderkey % 2 * 2 + 1)::INT, 2))))::INT AS score FROM orders")
def exact_match(spark, sf):
    gold = F.substring(F.lit(" f o "), (F.col("o_orderkey") % 2 * 2 + 1).cast("int"), F.lit(2))
    return _read(spark, sf, "orders").select("o_orderkey", score.exact_match(F.col("o_orderstatus"), gold).alias("score"))


@query(
    f"""{_RESPONSES}, c AS (SELECT score, unnest([{{'cut': 'all', 'value': 'all'}}, {{'cut': 'l_returnflag', 'value': l_returnflag}}, {{'cut': 'kind', 'value': kind}}]) AS c FROM s)
SELECT c.cut AS cut, c.value AS value, count(*) AS n, sum(score)::BIGINT AS n_correct, round(avg(score), 6) AS accuracy, round(coalesce(stddev_samp(score) / sqrt(count(*)), 0), 6) AS stderr FROM c GROUP BY ALL"""
)
def grouped_accuracy(spark, sf):
    scored = _responses(spark, sf).withColumn("score", score.by_type(F.col("kind"), F.col("response"), F.col("gold")))
    return score.accuracy(scored, "score", "l_returnflag", "kind")


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, (l_quantity::INT + l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE n % 5 WHEN 0 THEN n::VARCHAR WHEN 1 THEN (n % 4 + 1)::VARCHAR WHEN 2 THEN n || '/7' WHEN 3 THEN n || '.5' END AS number,
  CASE n % 5 WHEN 1 THEN substr('ABCD', n % 4 + 1, 1) WHEN 2 THEN 'A' WHEN 3 THEN CASE WHEN n % 10 = 3 THEN 'C' END WHEN 4 THEN substr('DCBA', n % 4 + 1, 1) END AS option FROM i"""
)
def answer_repair(spark, sf):
    """Answers repaired from solutions made of line items: units in boxes, phrases, fractions, anchors, and refusals with a boxed option."""
    n = F.col("n")
    solution = (
        F.when(n % 5 == 0, F.concat(F.lit("Thus \\boxed{x = "), "n", F.lit("\\text{ cm}} and \\boxed{\\frac{1}{2} = y}")))
        .when(n % 5 == 1, F.concat(F.lit("The correct answer is option ("), n % 4 + 1, F.lit(")")))
        .when(n % 5 == 2, F.concat(F.lit("\\boxed{a=b=1} so \\boxed{\\frac{"), "n", F.lit("}{7}}")))
        .when(n % 5 == 3, F.concat(F.lit("First 3, then 4.\n**Final Answer**: $"), "n", F.lit(".5$")))
        .otherwise(F.concat(F.lit("The question is incomplete, but \\boxed{\\text{("), F.substring(F.lit("dcba"), n % 4 + 1, F.lit(1)), F.lit(")}} fits 12.")))
    )
    boxes = _responses(spark, sf).select("l_orderkey", "l_linenumber", solution.alias("solution")).withColumn("boxes", A.boxed("solution"))
    return boxes.select("l_orderkey", "l_linenumber", A.repaired_number(F.col("solution"), F.col("boxes")).alias("number"), A.repaired_option(F.col("solution"), F.col("boxes")).alias("option"))


@query(
    f"""{_RESPONSES} SELECT CASE k WHEN 0 THEN 'mcq_single' WHEN 1 THEN 'mcq_multi' WHEN 2 THEN 'numerical' ELSE 'subjective' END AS answer_type,
  CASE WHEN k = 3 AND n % 8 = 3 THEN 'no_solution' WHEN k = 3 AND n % 16 = 7 THEN 'no_answer' WHEN l_linenumber % 2 = 0 OR k = 3 AND l_linenumber % 3 = 0 THEN 'matched' ELSE 'mismatched' END AS status, count(*) AS n
FROM s GROUP BY ALL"""
)
def consistency_report(spark, sf):
    """Match statuses by answer type: matched, mismatched, no_answer, no_solution."""
    n, line = F.col("n"), F.col("l_linenumber")
    kind = F.get(F.array(*map(F.lit, ("mcq_single", "mcq_multi", "numerical", "subjective"))), n % 4)
    gold = F.when(n % 4 < 2, F.col("gold")).when(n % 4 == 2, F.concat(n + line % 2, F.lit(".0"))).when(n % 16 == 7, " ").otherwise(F.when((line % 2 == 0) | (line % 3 == 0), "Vernier").otherwise("screw"))
    solution = F.when(n % 4 < 2, F.concat(F.lit("the answer is "), "value")).when(n % 4 == 2, F.concat(F.lit("so x ≈ "), "n", F.lit(" in all"))).when(n % 8 == 3, " ").otherwise("Read off the VERNIER scale.")
    rows = _responses(spark, sf).select(kind.alias("answer_type"), gold.alias("answer"), solution.alias("solution"))
    return quality.consistency(rows).groupBy("answer_type", "status").agg(F.count("*").alias("n"))


# Rewards


_HINDI = "यह एक लंबा प्रश्न है जिसका उत्तर देना है"


def _completions(spark, sf) -> DataFrame:
    """Whole texts within four kinds of responses: a step and an answer; an empty tag; steps in Hindi and no tag; an answer before the step."""
    kind, doc = F.col("doc_id") % 4, F.col("doc_id")
    subject = F.get(F.array(*map(F.lit, ("Physics", "chemistry", "maths", "biology", "art"))), (doc % 5).cast("int"))
    tag = F.concat(F.lit("<answer>"), doc % 3, F.lit("</answer>"))
    response = (
        F.when(kind == 0, F.concat(F.lit("Step 1. m = 2 kg\n"), "text", F.lit("\nHence the mean is 4\n"), tag))
        .when(kind == 1, F.concat("text", F.lit("\n<answer> </answer>")))
        .when(kind == 2, F.concat(F.repeat(F.lit(f"Step 1. {_HINDI}\n"), (doc % 40).cast("int")), "text"))
        .otherwise(F.concat(F.lit("Final answer: 1\n"), "text", F.lit("\nStep 1 since E = 2 V, thus cell\n"), tag))
    )
    prompt = F.when(doc % 3 > 0, _HINDI).otherwise("")
    return _docs(spark, sf).select("doc_id", prompt.alias("prompt"), response.alias("response"), (doc % 2).cast("string").alias("gold"), subject.alias("subject"))


_COMPLETIONS = f"""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Step 1. m = 2 kg' || chr(10) || text || chr(10) || 'Hence the mean is 4' || chr(10) || '<answer>' || (doc_id % 3) || '</answer>'
  WHEN 1 THEN text || chr(10) || '<answer> </answer>' WHEN 2 THEN repeat('Step 1. {_HINDI}' || chr(10), doc_id % 40) || text
  ELSE 'Final answer: 1' || chr(10) || text || chr(10) || 'Step 1 since E = 2 V, thus cell' || chr(10) || '<answer>' || (doc_id % 3) || '</answer>' END AS r, doc_id % 3 AS a, doc_id % 2 AS g, doc_id % 4 AS v,
  doc_id % 3 > 0 AS hindi, ['Physics', 'chemistry', 'maths', 'biology', 'art'][doc_id % 5 + 1] AS subject FROM documents)"""
_STEPS = r"Step\s*\p{Nd}|चरण\s*\p{Nd}|पद\s*\p{Nd}"
_REWARDS = {
    "correctness": "CASE WHEN v IN (0, 3) AND a = g THEN 2.0 ELSE 0.0 END",
    "format": rf"""round(CASE WHEN regexp_matches(body, '{_STEPS}|\p{{Nd}}+[.)]\s') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(body, '[=+\-×÷^]|\\frac|\\int|_\{{|\bmod\b') THEN 0.10 ELSE 0 END
  + CASE WHEN v IN (0, 3) THEN 0.10 ELSE 0 END, 4)""",
    "reasoning": rf"""round(greatest(least(CASE WHEN steps >= 5 THEN 0.2 WHEN steps >= 3 THEN 0.15 WHEN steps >= 1 THEN 0.05 ELSE 0 END
  + CASE WHEN regexp_matches(r, '[=×÷∫∑√∞∂±]|\\frac|\\int|\\sum|[a-zA-Z]\^|[a-zA-Z]_[0-9]') THEN 0.10 ELSE 0 END + CASE WHEN links >= 2 THEN 0.10 WHEN links >= 1 THEN 0.05 ELSE 0 END
  - CASE WHEN instr(lower(r), 'step') > 0 AND instr(lower(r), 'final answer') > 0 AND instr(lower(r), 'final answer') < instr(lower(r), 'step') THEN 0.10 ELSE 0 END, 0.5), 0), 4)""",
    "repetition": """CASE WHEN len(ls) < 2 OR length(tr) < 10 THEN 0 ELSE round(0.2 - CASE WHEN len(list_distinct(ls)) / len(ls) < 0.6 THEN 0.1 ELSE 0 END
  - CASE WHEN len(list_distinct(grams)) / greatest(len(grams), 1) < 0.5 THEN 0.1 ELSE 0 END, 4) END""",
    "subject": "CASE lower(subject) " + " ".join(
        f"WHEN '{name}' THEN " + " + ".join(f"CASE WHEN regexp_matches(r, '{p}') THEN 0.1 ELSE 0 END" for p in patterns)
        for name, patterns in (("physics", score.SUBJECT_TERMS[0][1:]), ("chemistry", score.SUBJECT_TERMS[1][1:]), ("maths", score.SUBJECT_TERMS[2][1:]), ("biology", score.SUBJECT_TERMS[3][1:]))
    ) + " ELSE 0 END",
    "hindi": """CASE WHEN NOT hindi THEN 0 ELSE round(CASE WHEN share >= 0.5 THEN 0.15 WHEN share >= 0.2 THEN 0.10 WHEN share >= 0.05 THEN 0.03 ELSE 0 END
  + CASE WHEN marks >= 5 THEN 0.10 WHEN marks >= 2 THEN 0.05 ELSE 0 END, 4) END""",
}
_REWARDED = rf"""{_COMPLETIONS}, p AS (SELECT *, list_filter(list_transform(string_split(r, chr(10)), lambda x: {_sql_trim('x')}), lambda x: x <> '') AS ls, {_sql_words('r')} AS w, {_sql_trim('r')} AS tr,
  CASE WHEN contains(r, '<answer>') THEN left(r, (instr(r, '<answer>') - 1)::INT) ELSE r END AS body,
  greatest(len(regexp_extract_all(r, '{_STEPS}')), len(regexp_extract_all(r, '(?m)^\s*\p{{Nd}}+[.)]\s'))) AS steps, len(regexp_extract_all(r, '(?i)because|therefore|hence|thus|since')) AS links,
  len(regexp_extract_all(r, '[\x{{0900}}-\x{{097F}}]')) / length({_sql_trim('r')}) AS share, len(regexp_extract_all(r, '{score.HINDI_MARKERS}')) AS marks FROM c),
q AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')) AS grams FROM p),
f AS (SELECT doc_id, {", ".join(f"({x})::DOUBLE AS reward_{k}" for k, x in _REWARDS.items())} FROM q)"""


def _reward(name: str) -> None:
    def run(spark, sf):
        make, args = score.REWARDS[name]
        return _completions(spark, sf).select("doc_id", make(*map(F.col, args)).alias("reward"))

    run.__name__ = f"reward_{name}"
    query(f"{_REWARDED} SELECT doc_id, reward_{name} AS reward FROM f")(run)


for _name in score.REWARDS:
    _reward(_name)


@query(f"{_REWARDED} SELECT *, round({' + '.join(f'reward_{k}' for k in _REWARDS)}, 4) AS reward_total FROM f")
def reward_total(spark, sf):
    return score.with_rewards(_completions(spark, sf)).select("doc_id", *[f"reward_{k}" for k in score.REWARDS], "reward_total")


# Sequences


_PACKS = f"""lengths AS (SELECT doc_id, text, len({_sql_words('text')}) AS n FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM lengths WHERE n > 0),
packs AS (SELECT k, doc_id, n, n AS used, 0::BIGINT AS pack FROM r WHERE k = 1 UNION ALL
  SELECT r.k, r.doc_id, r.n, CASE WHEN used + r.n > 4096 THEN r.n ELSE used + r.n END, pack + (used + r.n > 4096)::INT FROM packs JOIN r ON r.k = packs.k + 1)"""


def _packs(spark, sf) -> DataFrame:
    lengths = sequence.token_lengths(_docs(spark, sf), "doc_id", "text")
    return sequence.pack(lengths, "id", "n", 4096)


@query(f"WITH RECURSIVE {_PACKS} SELECT doc_id, pack, n FROM packs")
def pack_sequences(spark, sf):
    return _packs(spark, sf).select(F.col("ord").alias("doc_id"), "pack", "n")


@query(f"WITH RECURSIVE {_PACKS} SELECT pack, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, md5(string_agg(text, '' ORDER BY doc_id)) AS text_md5 FROM packs JOIN documents USING (doc_id) GROUP BY pack")
def packed_texts(spark, sf):
    found = sequence.packed_texts(_packs(spark, sf), _docs(spark, sf), "doc_id", "text")
    return found.select("pack", F.col("rows").alias("n_docs"), F.col("n").alias("n_tokens"), F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, len({_sql_words('text')})::BIGINT AS n_tokens FROM documents")
def token_lengths(spark, sf):
    return sequence.token_lengths(_docs(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"))


@query(
    """WITH t AS (SELECT conv_id, turn, turn + 1 AS asked, turn % 3 + 1 AS said FROM conversations),
e AS (SELECT *, sum(asked + said + 4) OVER (PARTITION BY conv_id ORDER BY turn) AS stop FROM t), b AS (SELECT *, stop - said - 2 AS mark FROM e)
SELECT conv_id, least(64, max(stop))::INT AS n_ids, coalesce(sum(least(stop, 64) - mark) FILTER (mark + 2 <= 64), 0)::INT AS n_trainable FROM b GROUP BY conv_id"""
)
def loss_mask(spark, sf):
    """Turns of an instruction marker and tokens, a response marker and tokens; labels from a response marker to the next instruction marker."""
    turn = F.col("turn").cast("int")
    ids = F.concat(F.array(F.lit(1), F.lit(2)), F.sequence(F.lit(10), F.lit(10) + turn), F.array(F.lit(3), F.lit(4)), F.sequence(F.lit(1000), F.lit(1000) + turn % 3))
    rows = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", ids.alias("x")))), lambda t: t["x"])).alias("ids"))
    masked = rows.select("conv_id", sequence.loss_mask(F.col("ids"), [3, 4], [1, 2], 64).alias("m"))
    return masked.select("conv_id", F.size("m.input_ids").alias("n_ids"), sequence.trainable(F.col("m.labels")).alias("n_trainable"))


@query(
    """WITH s AS (SELECT doc_id, doc_id // 8 AS batch, (doc_id % 7 + 1) AS n FROM documents)
SELECT doc_id, max(n) OVER (PARTITION BY batch)::INT AS padded, n::INT AS attended FROM s"""
)
def pad_batch(spark, sf):
    ids = F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = _docs(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), ids.alias("input_ids"), ids.alias("labels"))
    padded = sequence.pad_batch(rows, "batch", 0)
    return padded.select("doc_id", F.size("input_ids").alias("padded"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"))


# Resuming, JSON answers, merges


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    return _docs(spark, sf).select("doc_id").join(_read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a,' || event_id WHEN 1 THEN event_id::VARCHAR ELSE 'x ' || event_id END AS answer FROM events")
def json_answers(spark, sf):
    listed = F.concat(F.lit('["a", "'), "event_id", F.lit('"]'))
    raw = F.when(F.col("event_id") % 3 == 0, listed).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise(F.concat(F.lit(" x "), "event_id"))
    return _read(spark, sf, "events").select("event_id", shape.json_answer(raw).alias("answer"))


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS score FROM orders GROUP BY o_custkey")
def phase_merge(spark, sf):
    return _read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("score"))


# Sources and their policies

_COT = f"""cot AS (SELECT doc_id AS ord, text AS question, text AS answer, source, len({_sql_words('text')}) AS n, lang FROM documents),
judged AS (SELECT *, CASE WHEN coalesce(question, '') = '' THEN 'missing' WHEN lang IS NULL OR lang = 'de' THEN 'no_answer' WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'too_short' WHEN n > 3000 THEN 'too_long' END AS reason FROM cot)"""


def _cot(spark, sf) -> DataFrame:
    """Whole texts as problems with their solutions; those in one language count as not answered."""
    kind = F.when(F.col("lang") != "de", "has_answer_extracted")
    return _docs(spark, sf).select(
        F.col("doc_id").alias("ord"), F.col("text").alias("problem"), F.col("text").alias("generated_solution"),
        kind.alias("problem_type"), F.col("source").alias("problem_source"),
    )


@query(f"WITH {_COT} SELECT ord, reason, coalesce(source, 'unknown') AS problem_source, coalesce(reason, 'kept') = 'kept' AS kept FROM judged")
def policy_math_cot(spark, sf):
    rows = policies.judged(_cot(spark, sf), "math_cot", "ord")
    return rows.select("ord", "reason", F.col("metadata")["problem_source"].alias("problem_source"), F.col("reason").isNull().alias("kept"))


@query(
    f"""WITH p AS (SELECT p_partkey AS ord, 'Which? ' || p_name || chr(10) || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type AS question, p_size % 3 AS a, repeat(p_name || ' ', p_size) AS lecture, p_brand, p_type FROM part),
q AS (SELECT ord, question, a, 'The correct answer is: ' || CASE a WHEN 0 THEN p_brand ELSE p_type END || chr(10) || chr(10) || lecture || chr(10) || chr(10) || 'Explanation: ' || p_type AS answer FROM p),
r AS (SELECT ord, CASE WHEN a > 1 THEN 'no_such_choice' WHEN len({_sql_words('answer')}) < 30 THEN 'too_short' END AS reason, question, answer FROM q)
SELECT ord, reason, md5(question) AS question_md5, CASE WHEN reason IS NULL THEN md5(answer) END AS answer_md5 FROM r"""
)
def policy_mcq_image(spark, sf):
    df = _read(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.lit(None).cast("binary").alias("image"), F.concat(F.lit("Which? "), "p_name").alias("question"),
        F.array("p_brand", "p_type").alias("choices"), (F.col("p_size") % 3).cast("int").alias("answer"),
        F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size").cast("int")).alias("lecture"), F.col("p_type").alias("solution"),
    )
    rows = policies.judged(df, "mcq_image", "ord")
    return rows.select("ord", "reason", F.md5("question").alias("question_md5"), F.when(F.col("reason").isNull(), F.md5("answer")).alias("answer_md5"))


@query(
    f"""WITH d AS (SELECT doc_id AS ord, text, len({_sql_words('text')}) AS n, ['Maths', 'physics ', 'Science', NULL][(doc_id % 4 + 1)::INT] AS s, (doc_id % 13)::INT AS g FROM documents),
e AS (SELECT *, CASE coalesce(s, 'general') WHEN 'Maths' THEN 'mathematics' WHEN 'physics ' THEN 'physics' WHEN 'Science' THEN 'science' ELSE 'general' END AS subject FROM d)
SELECT ord, subject, CASE WHEN coalesce(text, '') = '' THEN 'missing' WHEN n < 10 THEN 'too_short'
  WHEN NOT ((subject = 'science' AND g BETWEEN 6 AND 10) OR (subject = 'mathematics' AND g BETWEEN 6 AND 12) OR (subject = 'physics' AND g IN (11, 12))) THEN 'out_of_grade' END AS reason FROM e"""
)
def policy_school(spark, sf):
    subject = F.get(F.array(F.lit("Maths"), F.lit("physics "), F.lit("Science"), F.lit(None)), (F.col("doc_id") % 4).cast("int"))
    df = _docs(spark, sf).select(F.col("doc_id").alias("ord"), F.col("text").alias("Question"), F.col("text").alias("response"), subject.alias("topic"), (F.col("doc_id") % 13).alias("Class"))
    return policies.judged(df, "school", "ord").select("ord", F.col("metadata")["subject"].alias("subject"), "reason")


@query(
    f"""WITH {_COT}, u AS (SELECT 0 AS prio, ord, question FROM judged WHERE reason IS NULL
  UNION ALL SELECT 8, conv_id * 1000 + turn, text FROM conversations WHERE coalesce(text, '') <> '')
SELECT prio, ord, md5(question) AS question_md5 FROM u QUALIFY row_number() OVER (PARTITION BY sha256({_sql_hash_normal('question')}) ORDER BY prio, ord) = 1"""
)
def policy_corpus(spark, sf):
    """Documents and single turns, by their policies, without questions that came before."""
    turns = F.lit(None).cast("array<struct<`from` string, value string>>").alias("conversations")
    order = (F.col("conv_id") * 1000 + F.col("turn")).alias("ord")
    said = _read(spark, sf, "conversations").select(order, turns, F.col("text").alias("instruction"), F.col("text").alias("output"))
    found = policies.corpus({"math_cot": _cot(spark, sf), "synthetic": said})
    return found.select("prio", "ord", F.md5("question").alias("question_md5"))

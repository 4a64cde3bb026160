"""The registered queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import bpe, decontaminate, exact_dedup, language_id, licenses, line_dedup, secrets, simhash, token_counts, urls

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.license_scan(_read(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_docs(_read(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_read(spark, sf_dir, "documents"), min_chars=line_dedup.MIN_CHARS, min_words=line_dedup.MIN_WORDS)
    return line_dedup.digests(found)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_scan(_read(spark, sf_dir, "documents")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).drop("bucket")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_url_filter, op3_decontaminate, op4_language_id, op5_byte_bpe,
        op6_token_counts, op7_simhash, op8_line_dedup, op9_secret_scan, op10_exact_dedup,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op3_decontaminate": f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
ks AS (SELECT DISTINCT k FROM items),
doc_windows AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, k FROM doc_windows JOIN item_windows USING (k, win)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
of_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hits GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
terms AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM items),
places AS (SELECT doc_id, item_id, any_value(n) AS n, p - j + s AS at, list(DISTINCT j) AS js FROM tokens JOIN terms USING (word), (SELECT unnest(range(-2, 3)) AS s)
  GROUP BY doc_id, item_id, p - j + s HAVING count(DISTINCT j) >= least(11, any_value(n))),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT *, unnest(range(1, greatest(n - 12, 1) + 1)) AS a FROM places)
  WHERE len(list_filter(js, lambda j: j BETWEEN a AND a + 12)) >= least(11, n) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN n_hit USING (doc_id) LEFT JOIN of_items USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op8_line_dedup": """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM docs) WHERE trim(ls[i]) <> ''),
uniq AS (SELECT line, min(doc_id * 1000000 + i) AS place, length(line) AS n FROM lines GROUP BY line),
near AS (SELECT DISTINCT y.line FROM uniq x JOIN uniq y ON x.place < y.place AND x.n BETWEEN y.n - 1 AND y.n + 1 AND x.n >= 20 AND y.n >= 20
  WHERE (left(x.line, (least(x.n, y.n) // 2)::INT) = left(y.line, (least(x.n, y.n) // 2)::INT) OR right(x.line, (least(x.n, y.n) // 2)::INT) = right(y.line, (least(x.n, y.n) // 2)::INT))
    AND levenshtein(x.line, y.line) <= 1),
wordy AS (SELECT place, line, string_split(line, ' ') AS w FROM uniq WHERE n >= 20 AND len(string_split(line, ' ')) >= 8),
without AS (SELECT line, place, k, w[1:k - 1] AS before, w[k + 1:len(w)] AS after FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM wordy)),
replaced AS (SELECT DISTINCT line FROM (SELECT line FROM without QUALIFY place > min(place) OVER (PARTITION BY k, before, after))),
marked AS (SELECT doc_id, i, line, doc_id * 1000000 + i <> place AS copy, line IN (SELECT line FROM near) OR line IN (SELECT line FROM replaced) AS near FROM lines JOIN uniq USING (line)),
out AS (SELECT doc_id, list(i) FILTER (copy OR near) AS gone, count(*) FILTER (copy) AS n_exact, count(*) FILTER (near AND NOT copy) AS n_near FROM marked GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near,
  (len(ls) - coalesce(n_exact, 0) - coalesce(n_near, 0))::BIGINT AS n_kept,
  sha256(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10))) AS text_sha256
FROM docs LEFT JOIN out USING (doc_id)""",
    "op10_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)""",
}

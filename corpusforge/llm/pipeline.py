"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.

A row is known by its id and text together, so rows that share an id are judged each by
itself. Tables may be empty at any stage, and further columns, whatever their names, are
carried along (but for names that begin with two underscores, which are used here).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, decontaminate, language_id, line_dedup, simhash
from corpusforge.llm.keys import row_key
from corpusforge.llm.queries import BPE_RANKS
from corpusforge.runtime import parted, remove, scratch, shared_dir, small, table

#: Languages to keep; None for all that can be learned from labels.
LANGUAGES: tuple[str, ...] | None = None
#: Cosine with the best language below which a text counts as none.
LEAST_SCORE = 0.1


def _with_row(docs: DataFrame) -> DataFrame:
    """``__row`` tells rows apart and orders them: by id, null ids last, then by hashes of id and text."""
    return docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *row_key(F.col("doc_id"), F.col("text"))))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (with ``__row``) but for the rows ``gone`` (r1, r2). Texts of rows that surely stay aren't shuffled."""
    few = table(gone.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct(), "gone")
    maybe, stay = parted(docs, F.col("__row.r1"), few.select("__r1"))
    return stay.union(maybe.join(small(few), (F.col("__row.r1") == F.col("__r1")) & (F.col("__row.r2") == F.col("__r2")), "left_anti")).drop("__row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = LANGUAGES, least: float = LEAST_SCORE) -> DataFrame:
    """Documents in a wanted language, with what was predicted as their ``lang``.

    Prototypes are learned from the rows that have a label. A document goes if its text is null
    or has no letter, if its best cosine is under ``least``, or if its language isn't ``wanted``
    (``None``: any will do). Without any label nothing can be learned; then all texts with a
    letter stay as they are. Repeated rows get the same decision.
    """
    prototypes = language_id.learn(docs, "text", "lang")
    if not prototypes:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = language_id.annotate(docs, prototypes, "text", "__lang", "__score").filter((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= least))
    judged = judged if wanted is None else judged.filter(F.col("__lang").isin(*wanted))
    return judged.withColumn("lang", F.col("__lang")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that came before, one edit or one replaced word away at most. ``n_chars`` follows the text.

    Null and empty texts stay as they are; repeated rows (id and text) count as one, so the first
    place of a line is in all of them; see :func:`corpusforge.llm.line_dedup.line_dedup`.
    """
    kept = line_dedup.line_dedup(docs, min_chars=line_dedup.MIN_CHARS, min_words=line_dedup.MIN_WORDS).drop("line_dedup")
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document: that of the smallest id, of equal ids that of the smallest hash.

    A null id comes after all others. Rows that repeat id and text are one document, and one of
    them stays. Null and empty texts have no words; they are duplicates of each other.
    """
    keyed = _with_row(docs)
    found = table(simhash.simhash_dedup(keyed, "__row").select("doc_id.r1", "doc_id.r2", (F.col("doc_id") == F.col("component_id")).alias("first")), "near-duplicates")
    again = small(table(found.groupBy("r1", "r2").count().filter("count > 1").select(F.struct("r1", "r2").alias("__again")), "repeated-rows"))
    at = F.struct("__row.r1", "__row.r2") == F.col("__again")
    once, repeated = keyed.join(again, at, "left_anti"), keyed.join(again, at, "left_semi").dropDuplicates(["__row"])
    return _without(once.union(repeated), found.filter(~F.col("first")))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark.

    Null and empty texts have no words and stay; an empty benchmark contaminates nothing; rows
    that repeat id and text get the same decision.
    """
    keyed = _with_row(docs)
    found = decontaminate.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row")
    return _without(keyed, found.filter("contaminated").select("doc_id.r1", "doc_id.r2"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``: token ids of each document, with digests of them and of what they decode to.

    ``ids`` holds unsigned 32-bit integers, little-endian. A null or empty text has none.
    Repeated rows give repeated results.
    """
    return bpe.digests(bpe.encode_docs(docs, BPE_RANKS, public_tokenizers.PATTERN), ids=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("decontaminate", benchmarks), ("byte_bpe", tokens)]

#: Fingerprints (XXH64) and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. Tables of a stage are removed once its rows are written, and these when the next one's are."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/corpusforge/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs

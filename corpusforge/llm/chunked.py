"""Texts that are longer than a chunk, cut into windows that different tasks can work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk; longer texts are worked on by several tasks.
CHUNK = 1 << 16


def whole_and_windows(docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, margin: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text)`` of the texts of at most ``chunk`` characters, and the windows of the others.

    Windows: ``doc_id, h, n, times, k, at, text``, where ``h`` is a hash of the whole text, ``n`` its
    length, ``times`` the number of rows with this id and text, which share their windows, ``k``
    the chunk's number and ``at`` where the window begins; it reaches ``margin`` characters
    beyond the chunk on both sides. A null text counts as empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n", F.char_length("text"))
    long = rows.filter(F.col("n") > chunk).withColumn("h", F.xxhash64("text"))
    long = long.groupBy("doc_id", "h", "n").agg(F.count("*").alias("times"), F.first("text").alias("text"))
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1)).alias("k")
    at = F.greatest(F.lit(0), F.col("k") * chunk - margin)
    cut = long.select("doc_id", "h", "n", "times", k, "text").withColumn("at", at)
    to = F.least(F.col("n"), (F.col("k") + 1) * chunk + margin)
    windows = cut.select("doc_id", "h", "n", "times", "k", "at", F.substring("text", F.col("at") + 1, to - F.col("at")).alias("text"))
    return rows.filter(F.col("n") <= chunk).select("doc_id", "text"), windows.repartition("doc_id", "h", "k")

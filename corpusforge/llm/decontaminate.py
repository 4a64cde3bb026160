"""Benchmark decontamination over a positional inverted index.

Postings (term, document, position) of the terms that benchmark items use are stored once.
A window of an item is nearly found where most of its terms are, each within a few places
of its offset. As few terms may lack, two of a few of them have to be found, whichever they
are; so the lists of each window's rarest terms are looked up first, and where two of them
meet, offsets adjusted, an item may be aligned with a document. For these alignments the
lists of all the item's terms are intersected the same way. A run of matched offsets that
holds a window is an exact phrase. Where enough terms of a window are found within the
slack, it's a proximity match. Which terms are rare is a matter of speed, not of results.

Everything is joins and aggregates of DataFrames. What is broadcast is counted first
(:func:`corpusforge.runtime.small`); beyond the bound, the same joins shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.llm.keys import ascii_lower, row_key
from corpusforge.runtime import parted, small, table

WINDOW, SLACK, NEAR_TERMS = 13, 2, 11
#: Fixed value: ASCII other than letters and digits parts words. (A-Z is lower-cased after that.)
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DOC = ["r1", "r2"]
#: Files of a table that grows with the benchmark and not with the corpus.
ITEM_FILES = 8
#: Rarest terms of a window that have to meet for an alignment, and places of a block.
_MEET, _BLOCK = 2, 32


def _item_table(df: DataFrame, label: str) -> DataFrame:
    """A table of the benchmark's, in few files: at one for each shuffle partition, making them costs more than their rows."""
    return table(df.coalesce(ITEM_FILES), label)


def _line(text: Column) -> Column:
    """The words as they are written, with one blank between."""
    return F.trim(F.regexp_replace(text, BETWEEN, " "))


def words(text: Column) -> Column:
    """Words as they are written; none of a null."""
    return F.filter(F.split(_line(text), " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many; 0 of a null."""
    return F.coalesce(F.transform(F.array(_line(text)), lambda x: F.when(x == "", 0).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1))[0], F.lit(0))


def _folded(word: Column) -> Column:
    """The word with A-Z lower-cased; most words have no upper case, which is cheaper to see."""
    return F.when(F.lower(word) == word, word).otherwise(ascii_lower(word))


@dataclass
class Matches:
    """``documents``: r1, r2, doc_id, n_words. ``runs``: r1, r2, item, first, last (positions of an exact
    phrase of an item, at least a window long). ``near``: r1, r2, item (with a proximity match)."""

    documents: DataFrame
    runs: DataFrame
    near: DataFrame
    items: DataFrame


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slack: int = SLACK,
    near_terms: int = NEAR_TERMS,
) -> Matches:
    """Exact phrase and proximity matches of benchmark windows in documents.

    A window is ``window`` consecutive words of an item; an item of fewer words is one
    window. A proximity match is a place in a document such that ``near_terms`` of a window's
    terms (all of them, if it has fewer) occur there, each at most ``slack`` places off.
    """
    rows = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = benchmark.select(F.col(item_col).alias("item_id"), words(ascii_lower(F.col(item_text_col))).alias("ws")).filter(F.size("ws") > 0)
    texts = _item_table(known.select("ws").distinct().select("ws", F.monotonically_increasing_id().alias("item")), "item-texts")
    items = _item_table(known.join(texts, "ws").select("item", "item_id").distinct(), "items")
    terms_of = _item_table(texts.select("item", F.size("ws").alias("n"), F.posexplode("ws").alias("j", "word")), "item-words")
    vocabulary = _item_table(terms_of.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
    terms_of = _item_table(terms_of.join(vocabulary, "word").select("item", "n", "j", "term"), "item-terms")

    tokens = rows.select(*_DOC, F.posexplode(F.split(_line(F.col("text")), " ")).alias("pos", "w")).select(*_DOC, "pos", _folded(F.col("w")).alias("word"))
    postings = table(tokens.join(small(vocabulary), "word").select(*_DOC, "pos", "term"), "postings")
    frequency = postings.groupBy("term").agg(F.count("*").alias("c"))

    # Of each window the rarest terms, and how many of them any match has.
    ahead = W.partitionBy("item").orderBy("j").rowsBetween(0, window - 1)
    size = F.least(F.lit(window), F.col("n"))
    found = F.least(F.lit(near_terms), size)
    ranked = terms_of.join(frequency, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ranked = ranked.withColumn("near", F.array_sort(F.collect_list(F.struct("c", "j", "term")).over(ahead))).filter(F.col("j") <= F.greatest(F.col("n") - window, F.lit(0)))
    ranked = ranked.withColumn("need", F.least(F.lit(_MEET), found)).withColumn("rare", F.slice("near", F.lit(1), size - found + F.col("need")))
    windows = _item_table(ranked.select("item", "need", F.array_sort(F.transform("rare", lambda x: x["j"])).alias("js")).distinct(), "windows")
    rarest = _item_table(ranked.select("item", "need", F.explode("rare").alias("x")).groupBy("item", "x.j", "x.term").agg(F.min("need").alias("need")), "rarest-terms")

    # Of two that meet at some alignment, each has a neighbour in the order of alignments that is no further off.
    first = postings.join(small(rarest), "term").select(*_DOC, "item", "need", "j", (F.col("pos") - F.col("j")).alias("d"))
    line, gap = W.partitionBy(*_DOC, "item").orderBy("d"), 2 * slack
    close = (F.col("d") - F.lag("d").over(line) <= gap) | (F.lead("d").over(line) - F.col("d") <= gap) | (F.col("need") == 1)
    around = F.explode(F.sequence(F.lit(-slack), F.lit(slack)))
    met = first.withColumn("close", close).filter("close").select(*_DOC, "item", "j", "d", around.alias("off"))
    met = met.groupBy(*_DOC, "item", (F.col("d") + F.col("off")).alias("at")).agg(F.collect_set("j").alias("found"))
    enough = F.size(F.array_intersect("found", "js")) >= F.col("need")
    alignments = table(met.join(small(windows), "item").filter(enough).select(*_DOC, "item", "at").distinct(), "alignments")

    # Alignments that are near each other look their terms up together, in blocks of places.
    together = alignments.groupBy(*_DOC, "item", F.floor(F.col("at") / _BLOCK).alias("near")).agg(F.collect_set("at").alias("ats"))
    probes = together.join(small(terms_of), "item").select(*_DOC, "item", "n", "j", "term", "ats", (F.array_min("ats") + F.col("j") - slack).alias("low"), (F.array_max("ats") + F.col("j") + slack).alias("high"))
    block = lambda c: F.floor(F.col(c) / _BLOCK)
    probes = probes.withColumn("block", F.explode(F.sequence(block("low"), block("high"))))
    concerned, _ = parted(postings, F.col("r1"), table(alignments.select("r1").distinct(), "aligned-documents"))
    lists = concerned.select(*_DOC, "term", "pos", block("pos").alias("block"))  # rows that repeat a document make no difference to a least distance
    matched = probes.join(lists, [*_DOC, "term", "block"]).filter(F.col("pos").between(F.col("low"), F.col("high")))
    matched = matched.select(*_DOC, "item", "n", "j", F.explode("ats").alias("at"), (F.col("pos") - F.col("j")).alias("d")).withColumn("off", F.abs(F.col("d") - F.col("at")))
    matched = table(matched.filter(F.col("off") <= slack).groupBy(*_DOC, "item", "at", "n", "j").agg(F.min("off").alias("off")), "matched-offsets")

    line = W.partitionBy(*_DOC, "item", "at").orderBy("j")
    exact = matched.filter("off = 0").withColumn("run", F.col("j") - F.row_number().over(line))
    runs = exact.groupBy(*_DOC, "item", "at", "n", "run").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    runs = runs.filter(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n")))
    runs = runs.select(*_DOC, "item", (F.col("at") + F.col("a")).alias("first"), (F.col("at") + F.col("b")).alias("last")).distinct()
    reach = F.count("*").over(line.rangeBetween(0, window - 1))
    near = matched.withColumn("found", reach).filter(F.col("found") >= F.least(F.lit(near_terms), F.col("n"))).select(*_DOC, "item").distinct()
    documents = rows.select(*_DOC, "doc_id", n_words(F.col("text")).cast("long").alias("n_words"))
    return Matches(documents, runs, near, items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near``.

    A word within any exact occurrence of a window is hit; ``n_items`` counts the items with
    one, ``items_sha256`` digests their ids (sorted as strings, comma-joined), and ``n_near``
    counts items with a proximity match. A document is contaminated if hit at all and at
    least a twentieth of its words are. Null and empty texts have no words; null and empty
    items have no windows; items with equal words are found together, each under its own
    id (null ids count, but have no place in the digest). Rows that repeat a document give
    repeated results. Empty tables are allowed; other columns are not looked at.
    """
    m = find_items(docs, benchmark, id_col, text_col, **options)
    hit = m.runs.select(*_DOC, F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy(*_DOC).agg(F.count("*").alias("n_hit"))
    of_items = m.runs.select(*_DOC, "item").distinct().join(small(m.items), "item")
    ids = F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",")
    found = of_items.groupBy(*_DOC).agg(F.count("*").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    near = m.near.join(small(m.items), "item").groupBy(*_DOC).agg(F.count("*").alias("n_near"))
    per_doc = table(hit.join(found, _DOC, "full").join(near, _DOC, "full"), "contaminations")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = m.documents.join(small(per_doc), _DOC, "left").select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), zero("n_near")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

"""Near duplicates in four gates: equal texts, a first embedding, word sets, and a second embedding for what is between."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import jaccard, lower_collapsed, text, words
from corpusforge.operators import dedup
from corpusforge.operators.embed import Embedder, embed
from corpusforge.runtime import table
from corpusforge.sources.files import resolve


@dataclass(frozen=True)
class NearDupConfig:
    """Thresholds of the gates. ``folder``: where gates are kept for a run that resumes, else nowhere;
    its rows and ``name`` tell its input from others there; ``fresh`` runs all gates again. A pair has to pass the first
    embedding and the word sets; it is looked for by word sets (exact), and only rows of such pairs are embedded. If
    no shared word is asked for (a threshold of 0), by random planes of all embeddings (99 % of pairs at the threshold).
    ``all_pairs``: multiply all first embeddings with all, by blocks."""

    semantic: float = 0.85
    confirmed: float = 0.60
    borderline: float = 0.50
    second: float = 0.88
    skip_second: bool = False
    all_pairs: bool = False
    across_only: int = 0
    folder: str | None = None
    name: str = "input"
    fresh: bool = False


@dataclass(frozen=True)
class NearDups:
    pairs: DataFrame  # i, j, label
    members: DataFrame  # id, group_id
    groups: DataFrame  # group_id, keep, size, confidence
    summary: DataFrame  # one row: total, removed, kept, reduction_pct
    removed_by: DataFrame  # confidence, removed


def _gate(df: DataFrame, name: str, config: NearDupConfig, rows: str = "") -> DataFrame:
    """The gate's rows as a table: one of an earlier run with the same input rows, name and thresholds, or a new one."""
    if not config.folder:
        return table(df, name)
    spark, known = df.sparkSession, {k: v for k, v in asdict(config).items() if k not in ("folder", "fresh")} | {"rows": rows}
    path = f"{config.folder.rstrip('/')}/{hashlib.sha256(repr(sorted(known.items())).encode()).hexdigest()[:16]}/{name}"
    try:
        there = not config.fresh and bool(resolve(spark, f"{path}/_SUCCESS"))
    except FileNotFoundError:
        there = False
    if not there:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def near_duplicates(df: DataFrame, id_col: str, question: str, answer: str, first: Callable[[], Embedder], second: Callable[[], Embedder] | None = None, config: NearDupConfig | None = None) -> NearDups:
    """Pairs, groups and what is kept of each: the longest answer, of equal ones the smallest id.

    Ids are whole numbers, each once; null texts count as empty. Texts equal but for case and white
    space are one class: its rows form a star, and only its first row meets the other gates.
    """
    config = config or NearDupConfig()
    rows = df.select(F.col(id_col).alias("id"), text(question).alias("q"), text(answer).alias("a"))
    key = F.md5(lower_collapsed(F.col("q")))
    # What the rows are, whatever their order: their number and sums of their hashes.
    seen = rows.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), "id", "q", "a").cast("decimal(38,0)")) for k in (0, 1)]).first() if config.folder else ()
    given = ":".join(map(str, seen))
    exact = _gate(dedup.star_pairs(rows, key, "id"), "gate-1", config, given)
    single = rows.join(exact.select(F.col("j").alias("id")), "id", "left_anti")

    least = min(config.confirmed, config.borderline)
    word_set = F.array_distinct(words(F.lower("q")))
    if config.all_pairs or least <= 0:
        embedded = _gate(embed(single, "id", "q", first), "vectors", config, given)  # a table, since it is read more than once
        find = dedup.cosine_pairs if config.all_pairs else dedup.cosine_pairs_by_planes
        found = find(embedded, "id", "embedding", config.semantic, across_only=config.across_only)
        close = _gate(found, "gate-2", config, given)
        of = lambda s: rows.select(F.col("id").alias(s), word_set.alias(f"w{s}"))
        a, b = F.col("wi"), F.col("wj")
        both_empty = (F.size(a) == 0) & (F.size(b) == 0)
        shared = close.select("i", "j").join(of("i"), "i").join(of("j"), "j").select("i", "j", F.when(both_empty, 1.0).otherwise(jaccard(a, b)).alias("sim"))
    else:
        # Rows without a word are one class, so that no two of them are left to be compared.
        sets = table(single.select(F.col("id").alias("class_id"), word_set.alias("tokens")), "word-sets", "zstd")
        alike = _gate(dedup.set_similarity_pairs(sets, least), "word-pairs", config, given)
        if config.across_only:
            alike = alike.filter(F.floor(F.col("i") / config.across_only) != F.floor(F.col("j") / config.across_only))
        ids = alike.select(F.explode(F.array("i", "j")).alias("id")).distinct()
        embedded = _gate(embed(rows.join(ids, "id", "left_semi"), "id", "q", first), "vectors", config, given)
        found = dedup.cosines(embedded, alike, "id", "embedding").filter(F.col("sim") >= config.semantic - 1e-12)
        close = _gate(found, "gate-2", config, given)
        shared = alike.join(close.select("i", "j"), ["i", "j"], "left_semi")
    tiers = _gate(dedup.tiers(shared, config.confirmed, config.borderline), "gate-3", config, given)
    gates = [
        exact.withColumn("label", F.lit(dedup.CONFIDENCE[0])),
        tiers.filter("tier = 'confirmed'").select("i", "j", F.lit(dedup.CONFIDENCE[2]).alias("label")),
    ]

    if second is not None and not config.skip_second:
        between = tiers.filter("tier = 'borderline'").select("i", "j")
        ids = between.select(F.explode(F.array("i", "j")).alias("id")).distinct()
        again = _gate(embed(rows.join(ids, "id"), "id", "q", second, batch=16), "second-vectors", config, given)
        passed = dedup.cosines(again, between, "id", "embedding").filter(F.col("sim") >= config.second)
        gates.append(_gate(passed.select("i", "j", F.lit(dedup.CONFIDENCE[1]).alias("label")), "gate-4", config, given))

    pairs = table(dedup.label_pairs(*gates), "near-pairs")
    members = table(dedup.groups(pairs), "near-members")
    kept = dedup.keep_longest(members, rows.select("id", F.char_length("a").alias("length")))
    groups = table(kept.join(dedup.group_confidence(members, pairs), "group_id"), "near-groups")
    gone = F.coalesce(F.sum(F.col("size") - 1), F.lit(0))
    summary = groups.agg(gone.alias("removed")).crossJoin(rows.agg(F.count("*").alias("total"))).select(
        "total", "removed", (F.col("total") - F.col("removed")).alias("kept"),
        F.round(F.coalesce(F.try_divide(F.col("removed") * 100.0, F.col("total")), F.lit(0.0)), 2).alias("reduction_pct"),
    )
    return NearDups(pairs, members, groups, summary, groups.groupBy("confidence").agg(gone.alias("removed")))


def mapping(found: NearDups, dataset: str) -> DataFrame:
    """One row ``line``: JSON of each group (group_id, keep, remove, size, confidence) and, as ``kind`` summary, of the totals.

    A group's ids to remove are in one array, as long as the group.
    """
    members = found.members.join(found.groups.select("group_id", "keep", "size", "confidence"), "group_id")
    gone = F.array_sort(F.collect_list(F.when(F.col("id") != F.col("keep"), F.col("id"))))
    grouped = members.groupBy("group_id", "keep", "size", "confidence").agg(gone.alias("remove"))
    lines = grouped.select(F.lit("group").alias("kind"), F.to_json(F.struct("group_id", "keep", "remove", "size", "confidence")).alias("line"))
    by = found.removed_by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("confidence", "removed")))).alias("removed_by_gate"))  # a row for each label at most
    total = found.summary.crossJoin(F.broadcast(by)).select(F.lit("summary").alias("kind"), F.to_json(F.struct(F.lit(dataset).alias("dataset"), "total", "removed", "kept", "reduction_pct", "removed_by_gate")).alias("line"))
    return total.union(lines)

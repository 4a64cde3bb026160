"""Token lengths, packing, loss masks and padding of training sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.runtime import small, table

IGNORE = -100
#: Sequence lengths to choose from.
BUCKETS = (512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192)


def length_stats(lengths: DataFrame, n: str) -> DataFrame:
    """One row: count, min, median, mean, p90, p95, p99 (interpolated, truncated), max."""
    p = lambda q: F.percentile(n, q).cast("long")
    return lengths.agg(
        F.count("*").alias("n"), F.min(n).cast("long").alias("min"), p(0.5).alias("median"), F.round(F.avg(n), 2).alias("mean"),
        p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(n).cast("long").alias("max"),
    )


def suggested_length(p95: Column, p99: Column, longest: Column) -> Column:
    """The first bucket that holds the longer of the two percentiles, else the longest seen."""
    fits = F.array_min(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b >= F.greatest(p95, p99)))
    return F.coalesce(fits.cast("long"), longest)


def _next_starts(sums: np.ndarray, limit: int) -> np.ndarray:
    """For a pack that begins at each row, the row at which the next one begins; ``sums``: tokens before each row, and in all."""
    at = np.searchsorted(sums, sums[:-1] + limit, side="right") - 1
    return np.maximum(at, np.arange(1, len(sums)))


def pack(df: DataFrame, order: str, n: str, limit: int, shard_rows: int = 1_000_000) -> DataFrame:
    """``(pack, order, n)``: all rows in order, a new pack being begun when the next row doesn't fit.

    A row above the limit is a pack of its own; rows of no tokens are in no pack; ``order`` is unique. The rows
    are cut into runs of about ``shard_rows``. What a run does depends only on where in it the first new
    pack begins; for each such place (at most ``limit`` of them) the run's task tells how many packs begin and
    how full the last one is left. One task goes through these, run by run, and tells each run what it begins with.
    """
    rows = df.select(F.col(order).alias("ord"), F.col(n).cast("long").alias("n")).filter("n > 0")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = table(rows.repartitionByRange(shards, "ord").sortWithinPartitions("ord").select(F.spark_partition_id().alias("shard"), "ord", "n"), "pack-runs")

    def sums_of(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        group = group.sort_values("ord")
        return group, np.concatenate(([0], np.cumsum(group["n"].to_numpy(np.int64))))

    def outcomes(group: pd.DataFrame) -> pd.DataFrame:
        group, sums = sums_of(group)
        m = len(group)
        following, packs, last = _next_starts(sums, limit).tolist(), [0] * (m + 1), list(range(m + 1))
        for i in range(m - 1, -1, -1):
            packs[i] = 1 + packs[following[i]]
            last[i] = last[following[i]] if following[i] < m else i
        first = np.arange(np.searchsorted(sums, limit, side="right"))
        left = [int(sums[m] - sums[last[i]]) if i < m else -1 for i in first]  # -1: no pack begins, the one before goes on
        return pd.DataFrame({"shard": group["shard"].iloc[0], "before": sums[first], "whole": sums[m], "packs": [packs[i] for i in first], "left": left})

    def stitch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, done, shard, rest = limit, 0, None, None

        def step(run: pd.DataFrame) -> pd.DataFrame:
            nonlocal used, done
            out = pd.DataFrame({"shard": [run["shard"].iloc[0]], "used": [used], "done": [done]})
            at = run.iloc[int(np.searchsorted(run["before"].to_numpy(), limit - min(used, limit), side="right")) - 1]
            used, done = (used + int(at["whole"]) if at["left"] < 0 else int(at["left"])), done + int(at["packs"])
            return out

        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            runs = [g for _, g in frame.groupby("shard", sort=False)]
            yield from map(step, runs[:-1])
            rest = runs[-1] if runs else None
        if rest is not None:
            yield step(rest)

    kind = rows.schema["ord"].dataType.simpleString()
    told = rows.groupBy("shard").applyInPandas(outcomes, "shard int, before long, whole long, packs long, left long")
    begins = table(told.repartition(1).sortWithinPartitions("shard", "before").mapInPandas(stitch, "shard int, used long, done long"), "pack-begins")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        used, done = int(group["used"].iloc[0]), int(group["done"].iloc[0])
        group, sums = sums_of(group)
        at, following = int(np.searchsorted(sums, limit - min(used, limit), side="right")) - 1, _next_starts(sums, limit)
        begun = np.zeros(len(group), np.int64)
        while at < len(group):
            begun[at] = 1
            at = int(following[at])
        return group.assign(pack=done - 1 + np.cumsum(begun))[["pack", "ord", "n"]]

    return rows.join(small(begins), "shard").groupBy("shard").applyInPandas(fill, f"pack long, ord {kind}, n long")


def packed_texts(packs: DataFrame, texts: DataFrame, order: str, text_col: str) -> DataFrame:
    """``(pack, rows, n, text)``: the texts of each pack's rows, one after the other. A pack is bounded by its tokens."""
    held = packs.join(texts.select(F.col(order).alias("ord"), F.col(text_col).alias("t")), "ord")
    parts = F.array_sort(F.collect_list(F.struct("ord", "t")))
    return held.groupBy("pack").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def loss_mask(ids: Column, response: list[int], instruction: list[int], limit: int) -> Column:
    """``input_ids`` cut to the limit and ``labels``: IGNORE but for spans from a response marker (included) to the next instruction marker."""

    def find(seq: list[int], marker: list[int], start: int) -> int:
        k = len(marker)
        return next((i for i in range(start, len(seq) - k + 1) if seq[i : i + k] == marker), -1)

    @F.pandas_udf("struct<input_ids: array<int>, labels: array<int>>")
    def mask(s: pd.Series) -> pd.DataFrame:
        out = []
        for seq in s:
            seq = [] if seq is None else [int(x) for x in seq[:limit]]
            labels, at = [IGNORE] * len(seq), 0
            while (begin := find(seq, response, at)) >= 0:
                end = find(seq, instruction, begin + len(response))
                end = len(seq) if end < 0 else end
                labels[begin:end] = seq[begin:end]
                at = end
            out.append((seq, labels))
        return pd.DataFrame(out, columns=["input_ids", "labels"])

    return mask(ids)


def trainable(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def pad_batch(df: DataFrame, batch: str, pad: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Rows padded on the right to the longest of their batch, with an attention mask from true lengths."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("__m"))
    gap = F.col("__m") - F.size(ids)
    wide = df.join(longest, batch)
    return wide.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap))).withColumns(
        {ids: F.concat(ids, F.array_repeat(F.lit(pad), gap)), labels: F.concat(labels, F.array_repeat(F.lit(IGNORE), gap))}
    ).drop("__m")


def token_lengths(df: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[str], list] = str.split) -> DataFrame:
    """``(id, n)`` by a pluggable tokenizer, in Arrow batches."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "n": f["text"].map(lambda t: len(tokenizer(t)))})

    return source.mapInPandas(count, f"id {source.schema['id'].dataType.simpleString()}, n long")

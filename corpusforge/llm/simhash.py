"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, Hamming checks, components.

A 64-bit fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at
most ``radius`` bits agree on at least ``blocks - radius`` parts, so every choice of that
many parts is a join key, and any close pair meets under one of them. Distinct
fingerprints only are joined (copies share theirs). Under a key, a forest that spans the
close pairs is returned instead of the pairs, so a dense group of m fingerprints gives
less than m links; a key with more than ``tile`` fingerprints is dealt out as pairs of
tiles, each of which fits a task, and so no task ever holds a whole hot group.

With 6 blocks and radius 4 there are 15 keys of 21 or 22 bits, which suits up to some
10 ** 8 distinct fingerprints; beyond, 8 blocks (70 keys of 32 bits) or 10 (210 keys of
38 or 39 bits) keep chance meetings rare. The links are the same for any choice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.components import connected_components
from corpusforge.runtime import small, table

SHINGLE_WORDS, RADIUS, BLOCKS, TILE = 4, 4, 6, 4096
_SOME = 1 << 15  # hashes counted at once


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the XXH64 hashes (seed 42) of a text's word shingles.

    A-Z are lower-cased; words are parted by ASCII white space. A text of fewer words is
    one shingle; one of none has fingerprint 0. A bit is 1 if set in over half the hashes.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    k = min(words, len(parts))
    line, n = b" ".join(parts), len(parts) - k + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, _SOME):
        some = [hash64(line[a:b], 42) for a, b in zip(starts[at : at + _SOME], stops[at : at + _SOME], strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return source.mapInArrow(apply, schema)


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Array of (choice of blocks, their bits packed together): the join keys of a fingerprint."""
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    cuts, keys = _cuts(blocks), []
    for choice, which in enumerate(combinations(range(blocks), blocks - radius)):
        packed, at = [], 0
        for i in which:
            low, width = cuts[i]
            packed.append(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)), at))
            at += width
        keys.append(F.struct(F.lit(choice).alias("c"), reduce(lambda a, b: a.bitwiseOR(b), packed).alias("v")))
    return F.array(*keys)


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(member, members linked to it): a forest that spans the pairs within ``radius``."""
    links, left = [], np.arange(len(fps))
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                hit = left[near]
                links.append((at, hit))
                queue.extend(hit)
                left = left[~near]
    return links


def _link(frames: Iterable[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of sorted frames with columns c, v, i, j, fp; a group may go on in the next frame."""
    keys, rest = ["c", "v", "i", "j"], None

    def links(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        fps, src, dst = frame["fp"].to_numpy(), [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                own = fps[a:b]
                for at, hit in spanning_links(own.view(np.uint64), radius):
                    src.append(np.full(len(hit), own[at]))
                    dst.append(own[hit])
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate(src or [none]), "b": np.concatenate(dst or [none])})

    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        k = frame[keys].to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1))
        yield links(frame, cuts)
        rest = frame.iloc[cuts[-1] :] if len(frame) else None
    if rest is not None:
        yield links(rest.reset_index(drop=True), np.array([0, len(rest)]))


def close_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``radius`` bits.

    ``distinct``: a written table with the distinct fingerprints in ``fp``.
    """
    keys = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k")).select("k.c", "k.v", "fp")
    hot = table(keys.groupBy("c", "v").count().filter(F.col("count") > tile).select("c", "v", F.ceil(F.col("count") / tile).cast("int").alias("n")), "hot-blocks")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.coalesce(F.col("n"), F.lit(1)) - 1),
        lambda x: F.struct(F.least(x, F.coalesce(F.col("own"), F.lit(0))).alias("i"), F.greatest(x, F.coalesce(F.col("own"), F.lit(0))).alias("j")),
    )
    dealt = keys.join(small(hot), ["c", "v"], "left").withColumn("own", own).select("c", "v", F.explode(tiles).alias("t"), "fp").select("c", "v", "t.i", "t.j", "fp")
    dealt = dealt.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")
    return dealt.mapInPandas(lambda frames: _link(frames, radius), "a long, b long")


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id that can be reached over links of at most
    ``radius`` differing bits, itself included. A null text has no words, and texts of no
    words share fingerprint 0, which links like any other. Null ids are passed by when the
    smallest is taken; a component of null ids only has a null ``component_id``. Repeated
    rows give repeated results; an empty table gives an empty one; other columns are not
    looked at.
    """
    prints = table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    parts = connected_components(close_links(distinct, radius, blocks, tile), "a", "b")
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

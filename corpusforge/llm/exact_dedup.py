"""Exact de-duplication over an extendible-hash index on shared files.

A text's key is a 64-bit hash. The directory maps the first bits of a key to a bucket: it
starts as one bucket, an overfull bucket is split at its next bit, and the directory
doubles when the bucket is as deep as itself. So a bucket is a range of keys.

Rows go to the task that owns their range of keys. There the texts of a key are chained:
each is compared, byte by byte, with the links of the key's chain and either counts for
the link that it equals or becomes a new one. The links (text, smallest digest, largest
id, number of rows) are the bucket files, in key order. Only they know which rows are
equal: documents look their link up by key, and where a chain has several links, by
digest. Further rows are inserted into an index by working on the buckets they fall in.

Keys with many rows, or with long texts, are merged where the rows are before they are
sent to an owner, so that no owner holds more than a bounded number of texts of a key.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.runtime import small, table

#: Keys a bucket may hold before it is split.
BUCKET_KEYS = 50_000
#: Most bits of a key that the directory looks at: a million pointers at the most, 12 MB.
MAX_DEPTH = 20
#: Rows of a key that are sent to its owner as they are, and bytes of their texts; beyond, they are merged before.
CHAINED_ROWS, CHAINED_BYTES = 64, 1 << 23
_OWNER_BITS, _ROOT = 16, 1


def split_overfull(buckets: set[int], counts: dict[int, int], depth: int, bucket_keys: int) -> dict[int, int]:
    """Buckets with their numbers of keys, after splits.

    A bucket that looks at the first ``l`` bits ``p`` of a key is number ``2 ** l + p``, so a
    split of ``b`` makes ``2 * b`` and ``2 * b + 1``. ``counts`` has the number of keys by their
    first ``depth`` bits; a bucket of that depth stays, however full.
    """
    sums = {1 << depth | p: n for p, n in counts.items()}
    level = dict(sums)
    for _ in range(depth):
        up: dict[int, int] = {}
        for b, n in level.items():
            up[b >> 1] = up.get(b >> 1, 0) + n
        sums |= up
        level = up
    out, open_ = {}, sorted(buckets, reverse=True)
    while open_:
        b = open_.pop()
        if b.bit_length() - 1 < depth and sums.get(b, 0) > bucket_keys:
            open_ += [2 * b + 1, 2 * b]
        else:
            out[b] = sums.get(b, 0)
    return out


def pointers(buckets: dict[int, int] | set[int]) -> tuple[int, list[tuple[int, int]]]:
    """The directory: its depth, and (first bits of a key, bucket) of all of its pointers."""
    depth = max(b.bit_length() for b in buckets) - 1
    spread = [(b, depth - b.bit_length() + 1) for b in buckets]
    return depth, sorted(((b << up) - (1 << depth) + i, b) for b, up in spread for i in range(1 << up))


@dataclass(frozen=True)
class Index:
    """``entries``: the links on shared files (bucket, key, link, links, text, sha, keep_id, group_size).
    ``buckets``: number of keys by bucket."""

    entries: DataFrame
    buckets: dict[int, int]


def _prefix(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _placed(rows: DataFrame, buckets: dict[int, int]) -> DataFrame:
    """Rows (with ``key``) and their ``bucket``. The directory has 2 ** MAX_DEPTH pointers at most, so it's broadcast."""
    depth, directory = pointers(buckets)
    small_ = rows.sparkSession.createDataFrame(directory, "p long, bucket long")
    return rows.withColumn("p", _prefix("key", depth)).join(F.broadcast(small_), "p").drop("p")


def _chain(rows: Column) -> Column:
    """The links of a key from its rows (t, id, n): each row's text is compared with the links there are."""

    def add(links: Column, row: Column) -> Column:
        merged = lambda x: F.struct(x["t"].alias("t"), F.greatest(x["id"], row["id"]).alias("id"), (x["n"] + row["n"]).alias("n"))
        counted = F.transform(links, lambda x: F.when(x["t"] == row["t"], merged(x)).otherwise(x))
        return F.when(F.exists(links, lambda x: x["t"] == row["t"]), counted).otherwise(F.concat(links, F.array(row)))

    chained = F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, 1, 1), add)
    return F.array_sort(F.when(F.size(rows) == 1, rows).otherwise(chained))


def _merge_hot(rows: DataFrame) -> DataFrame:
    """The rows (key, t, id, n) of which no key has more than a bounded number, or bytes, of texts."""
    sizes = table(rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.octet_length("t")).cast("long").alias("bytes")), "exact-keys")
    hot = sizes.filter((F.col("rows") > 1) & ((F.col("rows") > CHAINED_ROWS) | (F.col("rows") * F.col("bytes") > CHAINED_BYTES)))
    hot = small(table(hot.select("key"), "exact-hot-keys"))
    merged = rows.join(hot, "key", "left_semi").groupBy("key", "t").agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    return rows.join(hot, "key", "left_anti").union(merged)


def insert(index: Index | None, rows: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> Index:
    """The index with further rows (key, t, id); ``None`` for an empty one.

    Buckets that no row falls in keep their files. Ids are compared with those that are
    there: a link's ``keep_id`` is the largest that has been inserted with its text.
    """
    buckets = index.buckets if index else {_ROOT: 0}
    rows = rows.select("key", "t", "id", F.lit(1).cast("long").alias("n"))
    old = None
    if index:
        touched = table(_placed(rows.select("key"), buckets).select("bucket").distinct(), "exact-touched")
        old = index.entries.join(F.broadcast(touched), "bucket", "left_semi")  # as many as there are pointers at most
        rest = index.entries.join(F.broadcast(touched), "bucket", "left_anti")

    keys = rows.select("key") if old is None else rows.select("key").union(old.select("key"))
    keys = table(keys.distinct(), "exact-distinct-keys")
    n = keys.count()
    deepest = max(b.bit_length() for b in buckets) - 1
    depth = max(deepest, min(max_depth, max(0, (n // bucket_keys).bit_length() + deepest + 3)))
    counts = {r["p"]: r["count"] for r in keys.groupBy(_prefix("key", depth).alias("p")).count().collect()}  # 2 ** max_depth rows at most
    if index:
        seen = {r["bucket"] for r in touched.collect()}
        buckets = {b: k for b, k in buckets.items() if b not in seen} | split_overfull(seen, counts, depth, bucket_keys)
    else:
        buckets = split_overfull({_ROOT}, counts, depth, bucket_keys)

    rows = _merge_hot(rows)
    if old is not None:
        rows = rows.union(old.select("key", F.col("text").alias("t"), F.col("keep_id").alias("id"), F.col("group_size").alias("n")))
    owned = rows.withColumn("owner", _prefix("key", _OWNER_BITS)).repartition("owner")
    chains = owned.groupBy("owner", "key").agg(F.collect_list(F.struct("t", "id", "n")).alias("rs")).select("key", _chain(F.col("rs")).alias("c"))
    links = chains.select("key", F.size("c").alias("links"), F.posexplode("c").alias("link", "x"))
    links = _placed(links, buckets).select(
        "bucket", "key", "link", "links", F.col("x.t").alias("text"), F.unhex(F.sha2("x.t", 256)).alias("sha"), F.col("x.id").alias("keep_id"), F.col("x.n").alias("group_size")
    )
    links = table(links.sortWithinPartitions("bucket", "key", "link"), "exact-buckets")
    return Index(links if old is None else rest.unionByName(links), buckets)


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None, key_of: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("t"))
    return rows.withColumn("key", key_of(F.col("t")))


def lookup(index: Index, rows: DataFrame) -> DataFrame:
    """``id, keep_id, group_size, text_sha256, bucket`` of the rows (key, t, id) whose text has a link.

    All rows of a key have been compared with its chain, so where that has one link the key
    tells it; of several links the digest does.
    """
    wanted = rows.select("id", "key", F.unhex(F.sha2("t", 256)).alias("own"))
    links = index.entries.select("key", "links", "sha", "keep_id", "group_size", "bucket")
    found = wanted.join(links, "key").filter((F.col("links") == 1) | (F.col("own") == F.col("sha")))
    return found.select("id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"), "bucket")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    bucket_keys: int = BUCKET_KEYS,
    max_depth: int = MAX_DEPTH,
    key_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, bucket``.

    Of rows with equal normalised text the one with the largest id stays. A null text
    counts as empty, and empty texts are equal. A null id loses against any other; if a
    group has only null ids, ``keep_id`` is null and its rows are kept. Rows that repeat
    an id within a group all count in ``group_size`` and share the decision, being the
    same document. An empty table gives an empty result; other columns are not looked at.
    ``key_of`` may send different texts to one key: they are chained.
    """
    rows = _keyed(docs, id_col, text_col, normalise, key_of)
    found = lookup(insert(None, rows, bucket_keys, max_depth), rows)
    kept = F.col("keep_id").eqNullSafe(F.col("id")).alias("kept")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept, "text_sha256", "bucket")


def index_of(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, key_of: Callable[[Column], Column] = F.xxhash64, **sizes: int) -> Index:
    """An index of the documents, or a given one with these inserted too."""
    return insert(index, _keyed(docs, id_col, text_col, normalise, key_of), **sizes)

"""Deterministic limits, samples and quotas. Chance is a hash of a seed and the row's key, so no repartitioning changes a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusforge.runtime import table


def chance(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows at random (all, if there are fewer)."""
    return df.orderBy(chance(key, seed), key).limit(n)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Rows with their place in an order, from 0. Tasks sort ranges and count from the sum of those before, so no task holds all rows."""
    ranged = table(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__at")), "ranges")
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).count().withColumn("__before", F.sum("count").over(W.orderBy("__part")) - F.col("count"))  # a row for each task
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(name, place).drop("__part", "__at", "count", "__before")


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(chance(key, seed), key)


def stable_sort(df: DataFrame, *order: str, key: str) -> DataFrame:
    """Rows by ``order``; of equal ones in the order of ``key``."""
    return df.orderBy(*order, key)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cap_per_group(df: DataFrame, group: str, cap: int, *order: str) -> DataFrame:
    """The first ``cap`` rows of each group. A pre-limit by the group's rank keeps one group from being gathered whole."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__rank") <= cap).drop("__rank")


def hard_biased(df: DataFrame, n: int, length: str, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """If there are more than n rows: the longest floor(share * n), and the others at random."""
    hard = df.orderBy(F.desc(length), key).limit(int(share * n))
    rest = df.join(hard.select(key), key, "left_anti")
    return hard.unionByName(sample_n(rest, n - int(share * n), key, seed))


def balanced(df: DataFrame, n: int, group: str, key: str, seed: int = 42) -> DataFrame:
    """If there are more than n rows: max(1, n // groups) at random of each group, filled up with others to n in all.

    No more than n rows of a group can matter, so a group is cut to that where its rows are."""
    counts = df.agg(F.countDistinct(group).alias("k"), F.count("*").alias("n")).first()
    if counts["n"] <= n:
        return df
    quota = max(1, n // counts["k"])
    ranked = df.withColumn("__c", chance(key, seed)).withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy("__c", key))).filter(F.col("__r") <= n)
    return ranked.orderBy(F.col("__r") > quota, "__c", key).limit(n).drop("__c", "__r")


def split_quota(first: DataFrame, second: DataFrame, n: int, key: str) -> DataFrame:
    """At most half of n rows of the first table in order, and of the second as many as are then missing."""
    a = first.orderBy(key).limit(n // 2)
    return a.unionByName(second.orderBy(key).limit(n - a.count()))

"""Shared storage and size-checked broadcasts.

Everything that cuts lineage goes through :func:`table`: the rows are written as
Parquet under the folder the cluster names in ``spark.checkpoint.dir`` and read
back, so a lost executor never loses them and later plans see real columns and
sizes. Only where that setting is absent (tests, notebooks on one machine) a
temporary folder is made and removed at exit.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have, after counting, to be broadcast by :func:`small`.
BROADCAST_ROWS = 100_000
#: Bytes that their values may have.
BROADCAST_BYTES = 16 << 20

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="corpusforge-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage; one that isn't there is passed by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`table` writes inside are removed at the end; what is wanted of them has to be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def table(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write the rows to shared storage once; return the written table."""
    path = f"{shared_dir(df.sparkSession)}/corpusforge/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`table` wrote and nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, as it does at a collection of the driver's garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if it has at most ``rows`` rows and about ``size`` bytes, else as it is.

    ``df`` should be cheap to scan (a :func:`table`), since it is counted, and its strings,
    binaries and arrays are measured. Beyond the bounds the planner is left to shuffle,
    where adaptive execution splits hot keys.
    """
    long = [F.octet_length(c) if t in ("string", "binary") else F.octet_length(F.to_json(c)) for c, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "map"))]
    found = df.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in long]).first()
    return F.broadcast(df) if found[0] <= rows and sum(found[1:]) + 16 * len(df.columns) * found[0] <= size else df


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that surely have none) by a long column of hashes.

    ``keys``: a :func:`table` with one column of such hashes. Their last bits are marked in a bit map,
    64 to a row, which is broadcast: 16 bits for each key, at most 2 ** 27, so 32 MB. A row whose bit isn't
    marked can be kept or dropped without a shuffle; only the others need an exact join.
    """
    size = min(max((16 * keys.count()).bit_length(), 16), 27)
    place = lambda c: F.pmod(c, F.lit(1 << size)).cast("long")
    at = keys.select(place(F.col(keys.columns[0])).alias("x")).distinct()
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    marks = at.groupBy(F.shiftright("x", 6).alias("__word")).agg(F.bit_or(mask).alias("__bits"))
    marked = df.withColumn("__x", place(key)).withColumn("__word", F.shiftright("__x", 6)).join(F.broadcast(marks), "__word", "left")
    held = F.coalesce(F.getbit("__bits", F.col("__x").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return tuple(marked.filter(which).drop("__word", "__x", "__bits") for which in (held, ~held))

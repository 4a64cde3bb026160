"""What a run leaves: its configuration, results and samples, in a folder of its own; and logs of one row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_log(spark: SparkSession, path: str, **facts) -> None:
    """One JSON line with the facts of a run. Fails where something is already."""
    spark.createDataFrame([(json.dumps(facts, ensure_ascii=False, sort_keys=True, default=str),)], "value STRING").coalesce(1).write.mode("error").text(path)


def read_log(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()[0])


def write_run(root: str, run_id: str, config: dict, results: DataFrame, samples: DataFrame) -> str:
    """``root/run_id`` with ``samples`` by task, ``results`` and ``config``, written in this order: a run with a
    config is whole. ``results``: (task, phase, metric, value); ``samples`` have a column ``task``. A run id is written once.
    """
    path = f"{root.rstrip('/')}/{run_id}"
    samples.write.mode("error").partitionBy("task").parquet(f"{path}/samples")
    results.select("task", "phase", "metric", "value").write.mode("error").parquet(f"{path}/results")
    write_log(results.sparkSession, f"{path}/config", **config)
    return path


def merged(results: DataFrame) -> DataFrame:
    """Of each task and metric the value of the last phase."""
    return results.groupBy("task", "metric").agg(F.max_by("value", "phase").alias("value"))


def write_checkpoint(items: DataFrame, path: str, key: str, record: str, failed: str = "failed") -> None:
    """Append finished items: (key, status, record), where the status is ``ok`` for rows with a record and ``failed`` else."""
    status = F.when(F.col(record).isNull(), failed).otherwise("ok")
    items.select(F.col(key).cast("string").alias("key"), status.alias("status"), F.col(record).alias("record")).write.mode("append").parquet(path)


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item that was ever written: key, status and record; an ``ok`` one wins, so writing again changes nothing."""
    rows = spark.read.parquet(path)
    best = F.max_by(F.struct("status", "record"), F.col("status") == "ok").alias("x")
    return rows.groupBy("key").agg(best).select("key", "x.status", "x.record")


def resumable(found: DataFrame) -> DataFrame:
    """One row: how many items are done, and how many failed."""
    return found.agg(F.count_if(F.col("status") == "ok").alias("done"), F.count_if(F.col("status") != "ok").alias("failed"))

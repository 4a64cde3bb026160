"""Files that keep arriving, judged by a source's policy as they do."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusforge.sources.policies import judged


def ingest(
    spark: SparkSession, path: str, schema: str | T.StructType, policy: str, order: str, out: str, checkpoint: str, files_at_once: int = 1000
) -> StreamingQuery:
    """Judge the JSON lines that are in the folder and stop; called again, only files that came since are read.

    Rows go to ``out`` by whether they are ``accepted``. The checkpoint makes each file count once
    even if executors or the driver are lost. No state is kept, so memory doesn't grow with the stream;
    duplicates are looked for in the whole written table.
    """
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)
    rows = judged(lines, policy, order).selectExpr("*", "reason is null as accepted")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.partitionBy("accepted").trigger(availableNow=True).start()

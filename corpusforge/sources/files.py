"""Files of records: JSON lines, nested documents, Parquet; and what is written beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MALFORMED = "_malformed"


def resolve(spark: SparkSession, *candidates: str) -> str:
    """The first of the paths that exists; names all of them if none does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in candidates:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(candidates)}")


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Records of a file of JSON lines; blank lines are skipped.

    Strict: a malformed line stops the job. Otherwise its text is in the column
    ``_malformed``, which is null for records, so both can be counted in one pass.
    """
    wanted = _struct(schema)
    if strict:
        return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)
    with_text = T.StructType([*wanted.fields, T.StructField(MALFORMED, T.StringType())])
    return spark.read.schema(with_text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).json(path)


def read_nested(spark: SparkSession, path: str, schema: str | T.StructType, items: str) -> DataFrame:
    """One row for each element of the array ``items`` of documents that span lines, with ``ord`` in its document.

    The document's other columns go along; a column of the element wins over one of the same name.
    """
    docs = spark.read.schema(_struct(schema)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    of_item = docs.schema[items].dataType.elementType.names
    rest = [c for c in docs.columns if c != items and c not in of_item]
    rows = docs.select(*rest, F.posexplode(items).alias("ord", "_item"))
    return rows.select(*rest, F.col("ord").cast("long").alias("ord"), *[F.col("_item")[c].alias(c) for c in of_item])


def first_column(df: DataFrame, candidates: tuple[str, ...], needed: bool = False) -> Column:
    """The first of the columns that the table has; else null, or an error if it is needed."""
    for name in candidates:
        if name in df.columns:
            return df[name]
    if needed:
        raise ValueError(f"none of the columns {', '.join(candidates)} in {', '.join(df.columns)}")
    return F.lit(None).cast("string")


def folder_name(source_id: str, name: str) -> str:
    """Where the rows of a source are kept: lower case, with blanks and hyphens as underscores."""
    return f"{source_id}_{name}".lower().replace(" ", "_").replace("-", "_")


def write_lines(df: DataFrame, path: str, *partition: str) -> None:
    """JSON lines in UTF-8; nulls are written. Fails where something is already, so no input is overwritten."""
    df.write.mode("error").partitionBy(*partition).option("ignoreNullFields", False).json(path)


def split_rejected(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def unfinished(df: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the finished ones; a null key is never finished."""
    return df.join(finished.select(key).distinct(), key, "left_anti")

"""Expressions that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def row_key(id_col: Column, text: Column) -> tuple[Column, Column]:
    """128 bits, ``r1`` and ``r2``, that stand for a document (its id and text) and are never null."""
    return F.xxhash64(id_col, text).alias("r1"), F.xxhash64(F.lit(17), text, id_col).alias("r2")

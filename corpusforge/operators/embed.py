"""Vectors of texts by an embedder that is given: a model in the worker, or a service called in batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts to vectors, one for each text, in their order.
Embedder = Callable[[list[str]], list]


def with_retries(call: Embedder, tries: int = 3, wait: float = 2.0) -> Embedder:
    """An embedder that calls another one again after an error; the last error is raised, so no row is lost."""

    def embed(texts: list[str]) -> list:
        for n in range(1, tries + 1):
            try:
                return call(texts)
            except Exception:
                if n == tries:
                    raise
                time.sleep(wait)
        raise ValueError("tries must be at least 1")

    return embed


def embed(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Embedder], batch: int = 256) -> DataFrame:
    """``(id_col, embedding)`` of every row. ``make`` builds the embedder once in each task; null counts as empty.

    A task holds one batch of texts beside its Arrow batch. A service takes fewer at a time than a local model does (16).
    """
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                vectors = [[float(x) for x in v] for v in call(part["__text"].to_list())]
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": vectors})

    field = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"
    return rows.mapInPandas(run, f"{field}, embedding ARRAY<DOUBLE>")

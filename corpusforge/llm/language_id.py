"""Language identification with hyperdimensional profiles.

Each letter has a random vector of signs, which follows from its code point alone. The
vector of an n-gram binds its letters' vectors, each rotated by its place, by
multiplication. A text's vector bundles those of its n-grams, a language's prototype
bundles its texts', and a text is given to the prototype of the largest cosine. What all
languages have in common (the mean of the prototypes) is taken out of both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

DIMENSIONS, NGRAM = 512, 3
#: Most labelled rows that prototypes are learned from; picked by a hash, whatever the size of the table.
TRAINING_ROWS = 40_000
_CACHED_GRAMS, _PART = 1 << 14, 1 << 18
UNKNOWN = "und"
_LETTER, _BETWEEN = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


@lru_cache(maxsize=50_000)
def letter_vector(code: int) -> np.ndarray:
    """Random signs of a code point; the blank between words is code 32."""
    return np.random.default_rng([7, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Encoder:
    """Vectors of texts, with the vectors of n-grams kept."""

    def __init__(self):
        self._rows: dict[int, int] = {}
        self._grams = np.zeros((_CACHED_GRAMS, DIMENSIONS), np.int8)

    def _row(self, gram: int) -> int:
        at = len(self._rows)
        bound = np.ones(DIMENSIONS, np.int8)
        for place in range(NGRAM):
            bound = bound * np.roll(letter_vector(gram >> 21 * place & 0x1FFFFF), place)
        self._grams[at] = bound
        self._rows[gram] = at
        return at

    def _bundle(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.int64)
        grams, counts = np.unique(codes[:-2] | codes[1:-1] << 21 | codes[2:] << 42, return_counts=True)
        rows, some = self._rows, _CACHED_GRAMS // 4
        total = np.zeros(DIMENSIONS, np.float32)
        for i in range(0, len(grams), some):
            if len(rows) + some > _CACHED_GRAMS:
                rows.clear()
            at = [r if (r := rows.get(g)) is not None else self._row(g) for g in grams[i : i + some].tolist()]
            total += counts[i : i + some].astype(np.float32) @ self._grams[at].astype(np.float32)
        return total

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a text, or None if it has no letter. Words are letters and their marks; any run of others is one blank."""
        if text is None or not _LETTER.search(text):
            return None
        low, blank = text.lower(), np.array([32], np.uint32)
        total, tail = np.zeros(DIMENSIONS, np.float64), blank
        for i in range(0, len(low), _PART):
            line = _BETWEEN.sub(" ", low[i : i + _PART])
            line = line[1:] if tail[-1] == 32 and line[0] == " " else line
            codes = np.concatenate((tail, np.frombuffer(line.encode("utf-32-le"), np.uint32)))
            codes = np.concatenate((codes, blank)) if i + _PART >= len(low) and codes[-1] != 32 else codes
            if len(codes) > 2:
                total += self._bundle(codes)
            tail = codes[-2:]
        norm = np.linalg.norm(total)
        return total / norm if norm else None


@lru_cache(maxsize=1)
def _encoder() -> Encoder:
    return Encoder()


def chosen(share: float, *columns: str) -> Column:
    """True for about this share of rows: a hash of the columns as a fraction of 53 bits, so that no share is too small."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53) < share


def learn(docs: DataFrame, text_col: str, lang_col: str, training_rows: int = TRAINING_ROWS, id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """Prototype by language from rows with a label and a letter; at most about ``training_rows``.

    Where there are more, rows are picked by a hash of id and text, the same share of all. Partial
    sums are made where the rows are; by language and dimension they are summed up again, so what
    comes to the driver is one vector for each language.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    share = training_rows / max(rows.select("lang").count(), 1)
    rows = (rows.filter(chosen(share, "id", "text")) if share < 1 else rows).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = _encoder(), {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                if (v := encoder.vector(text.as_py())) is not None:
                    total[lang] = total.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v"))
    bundled = parts.groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    found = {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in bundled.collect()}
    return {k: found[k] / np.linalg.norm(found[k]) for k in sorted(found)}


class Judge:
    """Prototypes without what they have in common, which judge vectors by their cosine."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.langs = list(prototypes)
        common = np.mean([*prototypes.values()], axis=0) if len(self.langs) > 1 else np.zeros(DIMENSIONS)
        own = np.array([prototypes[x] - common for x in self.langs]).reshape(len(self.langs), DIMENSIONS)
        self.own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        self.line = common / max(np.linalg.norm(common), 1e-12)

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        """Language and score of each text."""
        encoder, lang, score = _encoder(), [], []
        for text in texts:
            v = encoder.vector(text.as_py()) if self.langs else None
            if v is None:
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            v = v - (v @ self.line) * self.line
            cosines = self.own @ v / max(np.linalg.norm(v), 1e-12)
            best = int(np.argmax(cosines))
            lang.append(self.langs[best])
            score.append(min(1.0, max(0.0, float(cosines[best]))))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]


def annotate(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The rows and columns of ``docs`` and two more, which must not be there yet; see :func:`identify`."""
    judge, text_at = Judge(prototypes), docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *judge.columns(b.column(text_at))], schema.names)

    return docs.mapInArrow(apply, schema)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``; see :func:`identify`."""
    source, judge = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), Judge(prototypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *judge.columns(b.column("text"))], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(apply, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training_rows: int = TRAINING_ROWS
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Prototypes are learned from rows whose fold (crc32 of the id as text, modulo 4) is not 2;
    the label, the id and any other column have no part in a prediction. A null text or one
    without a letter is ``und`` with score 0, and so is every text if nothing could be
    learned. Ties go to the first language in order. A null id has the fold of the text
    ``null``. Repeated rows give repeated results; an empty table gives an empty one.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    held_out = F.crc32(key) % 4 == 2
    prototypes = learn(docs.filter(~held_out), text_col, lang_col, training_rows, id_col)
    found = predict(docs, prototypes, id_col, text_col)
    return found.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 4 == 2).alias("held_out"), "lang_pred", "score")

"""The public entry to segmentation: load a model once, then columns, tables, SQL functions and streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kireme.errors import InvalidUtf8
from kireme.functions.text import escape_word
from kireme.operators.scoring import scorer_of, segments, units
from kireme.operators.workers import once
from kireme.sources.models import LinearModel, NeuralModel, load_model, read_bytes

WORDS = "array<struct<start:bigint,end:bigint>>"
SURFACES = "array<struct<start:bigint,end:bigint,surface:string>>"
#: Code points that are scored at once in a worker.
CHUNK = 1 << 18
_WORD = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def space_model() -> NeuralModel:
    """A model that cuts a gap where exactly one neighbour is a space: an exclusive or, so it needs the hidden layer."""
    one = np.array([[[1], [-1]], [[-1], [1]]], np.int16)
    return NeuralModel(1, [0x20], np.array([[0], [0], [100]], np.int16), one, np.zeros(2), np.array([1, 1], np.int16), -50.0, 1.0, 1.0, 1.0, 1.0)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Segmenter:
    """Words of text columns under one model. The model is broadcast once; no operation shuffles."""

    def __init__(self, spark: SparkSession, model: LinearModel | NeuralModel, precision: str = "int16"):
        self.spark, self.model, self.precision = spark, model, precision
        self._shared = spark.sparkContext.broadcast((model, precision))

    @classmethod
    def load(cls, spark: SparkSession, path: str, backend: str | None = None, precision: str = "int16") -> Segmenter:
        """A model file; the backend is told from its first bytes unless named (linear, mlp, ed)."""
        return cls(spark, load_model(read_bytes(spark, path), backend), precision)

    def _words(self, surfaces: bool = False):
        shared = self._shared

        @F.arrow_udf(SURFACES if surfaces else WORDS)
        def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = once(shared, lambda v: scorer_of(*v))
            for batch in batches:
                texts = [t or "" for t in batch.to_pylist()]
                offsets, starts, ends = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for lo, hi in _chunks(texts):
                    at, start, end = segments(scorer, texts[lo:hi])
                    offsets.append(offsets[-1][-1] + at[1:])
                    starts.append(start)
                    ends.append(end)
                start, end = np.concatenate(starts), np.concatenate(ends)
                columns, fields = [pa.array(start), pa.array(end)], list(_WORD)
                if surfaces:
                    # words tile their texts, so their sizes cut the joined bytes
                    cuts = np.concatenate([[0], np.cumsum(end - start)])
                    joined = pa.py_buffer("".join(texts).encode("utf-8", "surrogatepass"))
                    columns.append(pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cuts.astype(np.int64)), joined).cast(pa.string()))
                    fields.append(pa.field("surface", pa.string()))
                yield pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=fields))

        return words

    def segment(self, text: Column) -> Column:
        """(start, end) byte offsets of every word; they tile the text. Null for null and for invalid UTF-8."""
        return F.when(F.is_valid_utf8(text), self._words()(F.try_validate_utf8(text)))

    def boundary_scores(self, text: Column) -> Column:
        """The score of every gap between units, in order; null for null and for invalid UTF-8."""
        shared = self._shared

        @F.arrow_udf("array<bigint>")
        def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = once(shared, lambda v: scorer_of(*v))
            for batch in batches:
                texts = [t or "" for t in batch.to_pylist()]
                parts, offsets = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
                for lo, hi in _chunks(texts):
                    u = units(texts[lo:hi], scorer.clustered)
                    parts.append(scorer.scores(u))
                    offsets.append(offsets[-1][-1] + np.cumsum(np.maximum(np.diff(u.first) - 1, 0)))
                yield pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(parts)))

        return F.when(F.is_valid_utf8(text), scores(F.try_validate_utf8(text)))

    def _located(self, text: Column) -> Column:
        return F.when(F.is_valid_utf8(text), self._words(surfaces=True)(F.try_validate_utf8(text)))

    def surfaces(self, text: Column) -> Column:
        """The words themselves; null for null and for invalid UTF-8."""
        return self._located(text)["surface"]

    def transform(self, df: DataFrame, text: str = "text", errors: str = "column") -> DataFrame:
        """Add ``words`` (offsets). Rows of invalid UTF-8 get an ``error`` code, or fail the query with ``errors="strict"``."""
        out = df.withColumn("words", self.segment(F.col(text)))
        bad = F.col(text).isNotNull() & ~F.is_valid_utf8(F.col(text))
        if errors == "strict":
            return out.withColumn("words", F.when(bad, F.raise_error(F.lit(InvalidUtf8.code)).cast(WORDS)).otherwise(F.col("words")))
        return out.withColumn("error", F.when(bad, F.lit(InvalidUtf8.code)))

    def explode(self, df: DataFrame, text: str = "text") -> DataFrame:
        """One row per word: the columns of ``df`` but the text, word_idx (from 0), start, end and surface."""
        rest = [c for c in df.columns if c != text]
        words = df.select(*rest, self._located(F.col(text)).alias("_words")).select(*rest, F.posexplode("_words").alias("word_idx", "_w"))
        return words.select(*rest, F.col("word_idx").cast("long").alias("word_idx"), F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), F.col("_w.surface").alias("surface"))

    def format_lines(self, df: DataFrame, text: str = "text", out: str = "line") -> DataFrame:
        """Add the line of escaped words joined by spaces."""
        return df.withColumn(out, F.array_join(F.transform(self.surfaces(F.col(text)), escape_word), " "))

    def register(self, name: str = "segment") -> None:
        """SQL functions: ``name(text)`` for offsets, and ``name_words(text)`` as a table function for use with LATERAL."""
        self.spark.udf.register(name, self._words())
        shared = self._shared

        @F.udtf(returnType="word_idx int, start bigint, end bigint, surface string")
        class Words:
            def __init__(self):
                self.scorer = once(shared, lambda v: scorer_of(*v))

            def eval(self, text: str):
                if text:
                    raw = text.encode("utf-8")
                    _, start, end = segments(self.scorer, [text])
                    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                        yield i, a, b, raw[a:b].decode("utf-8")

        self.spark.udtf.register(f"{name}_words", Words)

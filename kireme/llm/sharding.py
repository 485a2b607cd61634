"""Hilbert-curve ordering: shards that are narrow in several metadata dimensions at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import ranked

BITS = 10


def hilbert_index(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of ``coords``, each coordinate below 2**bits).

    J. Skilling, "Programming the Hilbert curve", 2004: axes are turned into the transposed index, whose bits are then
    interleaved. The order visits every cell once and moves by one in one dimension at each step.
    """
    x = [c.astype(np.int64) for c in coords.T]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (((v ^ t) >> b) & 1)
    return out


def log_dimension(value: Column, bits: int = BITS, top: float = 40.0) -> Column:
    """A quantised size: its logarithm to base 2, from 0 to ``top``, in 2**bits steps. Null and negative give 0."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(1 + F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))) * ((1 << bits) / top))).cast("int")


def name_dimension(value: Column, bits: int = BITS) -> Column:
    """A quantised name: equal names share a cell. Null counts as the empty name."""
    return F.pmod(F.crc32(F.coalesce(value, F.lit("")).cast("binary")), F.lit(1 << bits)).cast("int")


def hilbert_shards(rows: DataFrame, dimensions: list[Column], n_shards: int, *ties: str, bits: int = BITS) -> DataFrame:
    """Add ``curve`` (the cell's place on the curve), ``shard`` and ``slot`` to every row.

    Rows are sorted by curve index and then by ``ties``, and the order is cut into ``n_shards`` runs whose row counts are
    at most one apart. A cell that holds a third of all rows is cut like any other, because runs are cut by position.
    Other columns are carried along; those of ``rows`` that are named ``curve``, ``shard`` or ``slot`` are replaced, and
    names that start with an underscore are reserved.
    """
    if len(dimensions) * bits > 62:
        raise ValueError("the curve index must fit 62 bits")

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], 1), bits))

    placed = ranked(rows.withColumn("curve", curve(*dimensions)), "curve", *ties, rank="_rank", name="curve")
    total = placed.agg(F.count(F.lit(1))).first()[0]
    # integer arithmetic: shard s holds the ranks from ceil(s * total / n) on
    cut = F.expr(f"(_rank * {n_shards}L) div {max(total, 1)}L")
    return placed.withColumn("shard", cut.cast("int")).withColumn("slot", F.col("_rank") - F.expr(f"(cast(shard as long) * {total}L + {n_shards - 1}L) div {n_shards}L")).drop("_rank")


def _dimensions(body: Column) -> tuple[Column, list[Column]]:
    """A document's size, and its dimensions: language, source and size."""
    size = (F.octet_length(body) + 16).cast("long")
    return size, [name_dimension(F.col("lang")), name_dimension(F.col("source")), log_dimension(size)]


def document_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Shards of ``documents`` by language, source and size: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    Law ``rows``: counts at most one apart. Equal texts of one language and source share a cell and lie together in it.
    Null texts count 16 bytes; null names are cells of their own; repeated rows take different slots; an empty table
    gives no rows.
    """
    body = F.coalesce("text", F.lit(""))
    size, dimensions = _dimensions(body)
    slim = docs.select("doc_id", size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *[d.alias(f"_d{i}") for i, d in enumerate(dimensions)])
    placed = hilbert_shards(slim, [F.col(f"_d{i}") for i in range(len(dimensions))], n_shards, "text_crc32", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Write whole rows in shard folders, in the order of the curve and with ``slot``; the shards of ``document_shards``.

    Rows lie in curve order in every file, so minima and maxima of language, source and size in the footers let a reader
    skip files and row groups. Repeated rows are written as often as they come.
    """
    body = F.coalesce("text", F.lit(""))
    _, dimensions = _dimensions(body)
    tied = docs.withColumn("_crc", F.crc32(body.cast("binary")))
    # the range shuffle has put the rows in order: each task holds a run of few shards
    hilbert_shards(tied, dimensions, n_shards, "_crc", "doc_id").drop("_crc").write.partitionBy("shard").parquet(path)

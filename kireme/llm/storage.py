"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder and any other fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        # only threads of this one process read it
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kireme-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def raw(column: pa.Array) -> Iterator[bytes | None]:
    """The bytes of each text, whether they are valid UTF-8 or not."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py()


def decoded(column: pa.Array) -> Iterator[str | None]:
    """Each text; bytes that are no UTF-8 become replacement characters."""
    for value in raw(column):
        yield None if value is None else value.decode("utf-8", "replace")


def stored(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet (compressed by ``codec``, else as the session says) to the shared folder and read it back.

    The written table survives lost executors, and its rows (also those of ``spark_partition_id`` or other
    expressions that depend on the layout) stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, and so is never broadcast.

    Spark sizes a side by its columns and not by its rows: what an explode or a compressed file makes may be many times larger.
    """
    return df.hint("merge")


def ranked(df: DataFrame, *keys: str, rank: str = "rank", name: str = "ranked") -> DataFrame:
    """Gapless global position (from 0) of every row in the order of ``keys``, without a single-task window.

    ``df`` is stored first, because the range bounds are sampled from it before it is read again for the shuffle. One
    range shuffle sorts the rows, the sorted table is stored with each row's partition and place in it, and the
    rows before each partition are summed over one row per partition (as many as shuffle partitions, whatever the
    data). Hot keys do not matter if the last key tells rows apart: range bounds then cut through them. Equal keys get
    neighbouring positions in any order. Nulls come first. An empty table gives an empty table.
    """
    placed = stored(
        stored(df, name).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per shuffle partition, so this list is bounded by a Spark setting and not by the data
    before, starts = 0, []
    for pid, n in sorted((r["_pid"], r["_n"]) for r in sizes.collect()):
        starts.append((pid, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_pid int, _before long")
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(rank, F.col("_before") + F.col("_idx"))
        .drop("_pid", "_idx", "_before")
    )

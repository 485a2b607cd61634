"""Segmentation of a stream of lines: a stateless projection, with the same columns as the batch form, and an ordered sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kireme.plans.segmenter import Segmenter


def read_line_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as lines (``text``), split at newlines only."""
    return spark.readStream.text(path, lineSep="\n").select(F.col("value").alias("text"))


def segment_stream(segmenter: Segmenter, lines: DataFrame, text: str = "text") -> DataFrame:
    """Add the formatted ``line``; rows of invalid UTF-8 get a null line and an ``error``. No state is kept."""
    formatted = segmenter.format_lines(lines, text)
    return formatted.withColumn("error", F.when(~F.is_valid_utf8(F.col(text)), F.lit("InvalidUtf8")))


def write_line_stream(lines: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the formatted lines as text files, exactly once per input line."""
    return lines.filter("line IS NOT NULL").select("line").writeStream.format("text").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).outputMode("append").start(path)


def read_ordered_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as lines (``text``) with their ``file`` and ``block`` (where a split starts in it)."""
    meta = F.col("_metadata")
    lines = spark.readStream.text(path, lineSep="\n")
    return lines.select(F.col("value").alias("text"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))


def write_ordered_stream(segmenter: Segmenter, lines: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch of ``read_ordered_stream`` lines to ``path``/batch=<id>, in the order of files and lines.

    A batch replaces what an earlier try of the same id wrote, so a restart repeats nothing. At the first line of invalid
    UTF-8 the lines before it are written, and the stream ends with an error that names the file and the line (from 1); earlier
    batches stay. Restarted, it stops at the same line until the file is mended.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = ["file", "block", "place"]
        # rows of a split follow each other in their task
        batch = batch.withColumn("place", F.monotonically_increasing_id())
        # a bad line is rare, so this keeps one row of each file that has some
        bad = batch.filter(~F.is_valid_utf8("text")).select(F.struct(*order).alias("at")).agg(F.min("at").alias("at")).first()["at"]
        earlier = F.lit(True)
        if bad is not None:
            in_file = (F.col("block") < bad["block"]) | ((F.col("block") == bad["block"]) & (F.col("place") < bad["place"]))
            earlier = (F.col("file") < bad["file"]) | ((F.col("file") == bad["file"]) & in_file)
        whole = batch.filter(earlier)
        made = segmenter.format_lines(whole).select(*order, "line")
        made.sort(*order).select("line").write.mode("overwrite").text(f"{path}/batch={number}")
        if bad is not None:
            before = batch.filter((F.col("file") == bad["file"]) & in_file).count()
            raise ValueError(f"invalid UTF-8 in line {before + 1} of {bad['file']}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

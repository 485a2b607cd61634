"""Corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes the whole documents that its predecessor kept, as (spark, docs, sf_dir), and returns the columns of
``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kireme.llm import decontamination, packing, pii, quality, simhash
from kireme.llm.queries import table, word_vocabulary
from kireme.llm.storage import shuffled, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass every rule of the policy."""
    ledger = quality.apply_policy(quality.rule_ledger(docs)).withColumn("_part", F.spark_partition_id())
    # the partition's number keeps the filter above the measurements; pushed down, it would compute them once more per use
    return ledger.filter("kept AND _part >= 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: that of the smallest id, null ids last, and of equal ids one."""
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    return rows.join(shuffled(simhash.representatives(rows, "_row")), "_row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a full window of a benchmark item; cut the words of items shorter than a window out of the rest."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), offsets=True, carry=COLUMNS)
    some = F.col("n_hit") > 0
    kept = found.filter(~F.col("full")).withColumn("text", F.when(some, decontamination.without(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(some, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    found = pii.personal_data(docs)
    some = F.size("spans") > 0
    return found.withColumn("text", F.when(some, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))).withColumn("n_chars", F.when(some, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences."""
    return packing.packed_documents(docs, word_vocabulary())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("personal data", redact), ("packing", pack)]
#: SimHash fingerprints and token ids have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs

"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import shuffled, stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every end of ``links`` (a, b).

    Each round points every node's larger neighbours, then its smaller ones, to the smallest node it knows. The rounds
    needed grow with the logarithm of the longest chain, the links never grow in number, and every round is stored in
    the shared folder so that lineage stays short. Smallest neighbours are aggregates (partial per task), so a node of
    very many links makes no large group; the joins that bring them back split by adaptive execution. Self links and
    repeated links are allowed; no links give an empty table.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(shuffled(lowest), "a").select("b", "m").filter("b <> m").distinct()
        # now every row has b > m: the small star of b
        least = large.groupBy("b").agg(F.min("m").alias("low"))
        small = large.join(shuffled(least), "b").select(F.explode(F.array(F.struct("m", "low"), F.struct(F.col("b").alias("m"), "low"))).alias("x")).select(F.col("x.low").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        links = stored(small, "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

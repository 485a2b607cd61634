"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ at 2 bits or fewer, one segment
then differs at one bit at most, so the two share a variant of that segment with one bit left out (a wildcard), or the
segment itself. Variants are joined by equality and candidates verified by counting the bits that differ:

* segment equal: its exact value is the key, and the other segment may differ at 2 bits;
* both segments differ at one bit: one wildcard variant of the first segment is the key; of the two partners one has
  the left-out bit set and one has not, so each pair is met once.

A key that many fingerprints share is not paired: its members are keyed again with wildcards in the other segment too
(496 two-bit or 32 one-bit variants). At most four fingerprints fit such a key, so it costs rows in proportion to its
members, and finds exactly the same links. No key is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kireme.llm.components import components
from kireme.llm.storage import raw, shuffled, stored

SEED = 42
#: Shingles that are hashed and counted at once, so that a very long text needs no more memory than this many.
BLOCK = 1 << 16
LOW = (1 << 32) - 1
#: Members of a key from which wildcards in the other segment make fewer rows than pairs do.
PAIRED_EQUAL = 2 * 496
PAIRED_WILD = 2 * 32


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``words``-word shingles of a text.

    A-Z are lower-cased and words are separated by ASCII blanks. Fewer words than a shingle needs make one shingle of
    all of them; a text without words, or null, has fingerprint 0. The text is given as bytes, of which any will do.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED) for i in range(at, min(n, at + BLOCK))), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, *keys: str) -> DataFrame:
    """``doc_id``, further ``keys`` (long) and ``fp`` (long, the unsigned value's bits) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in raw(batch.column(len(names)))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(fps.view(np.int64))], [*names, "fp"])

    names = ["doc_id", *keys]
    return docs.select(*names, "text").mapInArrow(run, "".join(f"{k} long, " for k in names) + "fp long")


def _linked(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``fps`` (distinct, column ``fp``) that connect all that differ at 2 bits or fewer.

    Every link is a pair of the result, or its two ends are connected through the smallest fingerprint of a shared key.
    """
    halves = fps.select("fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.col("fp").bitwiseAND(F.lit(LOW)).alias("lo"))
    equal = halves.select("fp", F.inline(F.array(F.struct(F.lit(0).alias("seg"), F.col("hi").alias("key"), F.col("lo").alias("other")), F.struct(F.lit(1).alias("seg"), F.col("lo").alias("key"), F.col("hi").alias("other")))))
    sized = equal.join(shuffled(equal.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), ["seg", "key"])
    few = sized.filter(F.col("n") <= PAIRED_EQUAL)
    paired = few.select("seg", "key", F.col("fp").alias("a")).join(shuffled(few.select("seg", "key", F.col("fp").alias("b"))), ["seg", "key"]).filter((F.col("a") < F.col("b")) & _linked("a", "b")).select("a", "b")
    pairs_of_bits = F.array(*[F.lit((1 << i) | (1 << j)) for i, j in combinations(range(32), 2)])
    hubs = sized.filter(F.col("n") > PAIRED_EQUAL).select("fp", "seg", "key", "other", F.explode(pairs_of_bits).alias("out")).select("fp", "seg", "key", "out", F.col("other").bitwiseAND(F.bitwise_not("out")).alias("rest"))
    stars = _stars(hubs, "seg", "key", "out", "rest")

    bits = F.array(*[F.lit(1 << i) for i in range(32)])
    wild = halves.select("fp", "hi", "lo", F.explode(bits).alias("out")).select("fp", "lo", "out", F.col("hi").bitwiseAND(F.bitwise_not("out")).alias("key"), (F.col("hi").bitwiseAND(F.col("out")) != 0).alias("on"))
    counts = wild.groupBy("out", "key").agg(F.count_if("on").alias("n1"), F.count_if(~F.col("on")).alias("n0")).filter("n1 > 0 AND n0 > 0")
    wild = wild.join(shuffled(counts), ["out", "key"])
    small = F.col("n1") * F.col("n0") <= (F.col("n1") + F.col("n0")) * (PAIRED_WILD // 2)
    on, off = wild.filter(small & F.col("on")), wild.filter(small & ~F.col("on"))
    crossed = on.select("out", "key", F.col("fp").alias("x")).join(shuffled(off.select("out", "key", F.col("fp").alias("y"))), ["out", "key"]).filter(_linked("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    many = wild.filter(~small).select("fp", "out", "key", "lo", F.explode(bits).alias("out2")).select("fp", "out", "key", "out2", F.col("lo").bitwiseAND(F.bitwise_not("out2")).alias("rest"))
    return paired.unionByName(stars).unionByName(crossed).unionByName(_stars(many, "out", "key", "out2", "rest"))


def _stars(keyed: DataFrame, *keys: str) -> DataFrame:
    """Links from the smallest fingerprint of each key to its other ones, four at most."""
    return (
        keyed.groupBy(*keys)
        .agg(F.collect_set("fp").alias("all"))
        .filter(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
        .filter("a < b")
    )


def _labelled(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (column ``fp``) with ``component``, the smallest fingerprint that links reach."""
    found = components(links(distinct.select("fp")))
    return distinct.join(shuffled(found.select(F.col("node").alias("fp"), "component")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def representatives(docs: DataFrame, key: str, words: int = 3) -> DataFrame:
    """``key`` (long, unique) of one row per component: of those with the smallest doc_id (nulls last) that of the smallest key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first")
    labelled = _labelled(stored(fingerprints(docs, words, key).groupBy("fp").agg(first), "distinct"))
    return labelled.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first")[key].alias(key))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    Documents are linked when their fingerprints differ at 2 bits or fewer; ``component_id`` is the smallest doc_id that
    links reach. Texts that are null, empty or without words share fingerprint 0 and link like any other. Rows with a
    null doc_id are linked too, but never name a component unless it holds nothing else (then null). Repeated rows are
    each returned. Exact copies are one fingerprint from the first aggregation on, whose partial sums absorb large groups.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    labelled = _labelled(stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct"))
    names = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(shuffled(names), "component").select("fp", "component_id")
    return prints.join(shuffled(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

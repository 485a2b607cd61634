"""Quality rules as a bitmask ledger, in SQL functions only.

``rule_ledger`` measures every text once and keeps one failure bit per rule; ``apply_policy`` turns the bits into a
verdict under a versioned policy (a mask of the rules that reject), and ``ablation`` counts, from the bits alone, what
each rule rejects by itself and what a policy would keep without it. No text is read twice for another policy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that separate words.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str
    """SQL condition over the measurements; a null counts as not failing."""


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "n_words > 0 AND word_chars < 3 * n_words"),
    Rule(3, "long_words", "n_words > 0 AND word_chars > 12 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
)
BASE = ("too_few_words", "repeated_windows")
POLICIES = {
    "base-v1": BASE,
    "web-v1": (*BASE, "short_words", "long_words", "symbols", "duplicate_lines"),
}


def mask_of(names) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in set(names))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long).

    A null text has no words and no lines. Columns of ``docs`` with those names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    inner = F.btrim(body, F.lit(BLANK_CHARS))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    with_words = docs.withColumn("_words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS))).withColumn("_lines", lines)
    # hashes of the windows tell cheaply that a text repeats none; only others are sorted as strings
    hashes = F.zip_with(
        F.zip_with("_words", F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)),
        F.slice("_words", 3, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda h, c: F.when(c.isNull(), None).otherwise(F.xxhash64(h, c)),
    )
    hashed = with_words.withColumn("_hashes", F.when(F.size("_words") >= 3, F.slice(hashes, 1, F.greatest(F.size("_words") - 2, F.lit(1)))))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    sorted_spans = F.array_sort(
        F.transform(
            F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.size("_words")).alias("b"), F.slice("_words", 3, F.size("_words")).alias("c")),
            lambda x, i: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("w"), i.alias("p")),
        )
    )
    spanned = hashed.withColumn("_spans", F.when(repeats, F.slice(sorted_spans, 1, F.size("_words"))))
    before = F.slice("_spans", 1, F.size("_spans") - 1)
    after = F.slice("_spans", 2, F.size("_spans") - 1)
    pairs = F.filter(
        F.zip_with(before, after, lambda a, b: F.when((a["w"] == b["w"]) & (a["p"] < F.size("_words") - 2) & (b["p"] < F.size("_words") - 2), F.array(a["p"], b["p"]))),
        lambda x: x.isNotNull(),
    )
    places = spanned.withColumn("_places", F.array_sort(F.array_distinct(F.flatten(pairs))))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return (
        places.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_words", "_lines", "_hashes", "_spans", "_places")
    )


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements of every row and ``fail_bits`` (long), bit ``r.bit`` set where rule ``r`` fails."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str = "web-v1") -> DataFrame:
    """Add ``kept``: no rule of the named policy fails."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0)


def ablation(ledger: DataFrame, policy: str = "web-v1") -> DataFrame:
    """One row per rule of the policy: rows that fail it, fail only it, and rows kept if it were left out.

    Computed from the stored bits in one aggregation; an empty ledger gives zeros.
    """
    mask = mask_of(POLICIES[policy])
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    sums = [F.count(F.lit(1)).alias("rows"), F.count_if(failed == 0).alias("kept")]
    for r in rules:
        sums += [F.count_if(failed.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}"), F.count_if(failed == (1 << r.bit)).alias(f"o{r.bit}")]
    return ledger.agg(*sums).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_failed_only"), (F.col("kept") + F.col(f"o{r.bit}")).alias("n_kept_without"), F.col("rows").alias("n_rows"))
                    for r in rules
                ]
            )
        )
    )


def quality_report(docs: DataFrame, policy: str = "web-v1") -> DataFrame:
    """One row per document: doc_id, the measurements, fail_bits, base_failed and kept.

    Null or empty text: no words, so ``too_few_words`` fails. Repeated rows each get a row.
    """
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return apply_policy(rule_ledger(docs.select("doc_id", "text")), policy).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "fail_bits", base.alias("base_failed"), "kept"
    )


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w3 FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w3) AS c FROM g) WHERE c > 1),
n AS (SELECT k, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN n USING (k)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words > 0 AND word_chars < 3 * n_words)::INT
             + 8 * (n_words > 0 AND word_chars > 12 * n_words)::INT + 16 * (10 * n_symbols > n_words)::INT + 32 * (10 * n_dup_lines > 4 * n_lines)::INT AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""

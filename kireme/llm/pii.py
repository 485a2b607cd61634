"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Generators with high recall propose spans, which may overlap. Each candidate falls into a cell of a grid of format and
context features. Validators look at what the features do not hold (checksums, number ranges, the variety of a secret's
characters) and give weak labels. Boosted trees (``pyspark.ml``) learn from one half of the texts' cells, weighted by
their counts, how likely a format in its context is confirmed; on the other half a threshold for each kind is calibrated
so that the validators confirm most of what it selects. Candidates in cells above their threshold are redacted, whether
their own label is set or not. The four validated base kinds are always kept, whatever the trees say.

Texts are scanned once: candidates are stored beside their rows. No text is shuffled, only counts of cells leave the
tasks, and what comes back is the list of selected cells, bounded by the grid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import stored

#: Base kinds, in the order that breaks ties of their starts. Lookbehinds and possessive repeats change no match: a
#: match starts where a run of its first characters starts or where the last match ended, and repeats never give back.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BLOCK = 128
#: Weak precision that a kind's threshold must reach.
PRECISION = 0.9
MARGIN = 0.5
TREES, DEPTH = 8, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, make: Callable[[Column, Column, Column, Column, Column], Column], none: str) -> Column:
    """``make(start, end, hit, left, right)`` of all leftmost non-overlapping matches, in code points from 0.

    ``left`` and ``right`` are up to 24 and 1 characters between this match and its neighbours. Starts are running
    sums of the lengths of gaps and hits, taken over blocks so that the work stays in proportion to the matches.
    """

    def place(x: Column) -> Column:
        # gaps are one more than hits
        sizes = F.zip_with(x["gaps"], x["hits"], lambda g, h: F.char_length(g) + F.coalesce(F.char_length(h), F.lit(0)))
        return let(
            F.struct(x["gaps"].alias("gaps"), x["hits"].alias("hits"), sizes.alias("sizes")),
            lambda y: let(
                F.struct(
                    y["gaps"].alias("gaps"),
                    y["hits"].alias("hits"),
                    y["sizes"].alias("sizes"),
                    F.transform(F.sequence(F.lit(0), F.floor((F.size(y["sizes"]) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(y["sizes"], b * BLOCK + 1, BLOCK))).alias("blocks"),
                ),
                lambda z: F.transform(
                    z["hits"],
                    lambda h, i: let(
                        _total(F.slice(z["blocks"], F.lit(1), F.floor(i / BLOCK).cast("int"))) + _total(F.slice(z["sizes"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)) + F.char_length(F.get(z["gaps"], i)),
                        lambda s: make(s, s + F.char_length(h), h, F.right(F.get(z["gaps"], i), F.lit(24)), F.left(F.get(z["gaps"], i + 1), F.lit(1))),
                    ),
                ),
            ),
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("gaps")), place)).otherwise(F.expr(f"cast(array() as {none})")))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    # from the right, every second digit is doubled and a result over 9 loses 9
    value = lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _card(hit: Column) -> Column:
    return let(_digits(hit), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255)


def _phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(10, 15)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _base(text: Column, kind: int, pattern: str, valid: Callable[[Column], Column] | None, sign: Column) -> Column:
    found = located(text, pattern, lambda s, e, h, le, r: F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end"), (valid(h) if valid else F.lit(True)).alias("ok")), "array<struct<start:int,kind:int,end:int,ok:boolean>>")
    kept = F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(sign, kept).otherwise(F.expr(f"cast(array() as {SPAN})"))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_email``, ``_ip``, ``_card`` and ``_phone``: arrays of (start, kind, end)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("_email", _base(t, 0, EMAIL, None, F.contains(t, F.lit("@"))))
        .withColumn("_ip", _base(t, 1, IP, _ip, F.contains(t, F.lit("."))))
        .withColumn("_card", _base(t, 2, CARD, _card, F.lit(True)))
        .withColumn("_phone", _base(t, 3, PHONE, _phone, F.contains(t, F.lit("+"))))
    )


@dataclass(frozen=True)
class Generator:
    """``sign``: a pattern that a text must contain; ``label``: weak label of a hit; ``base``: hits that the base kinds already hold."""

    kind: str
    pattern: str
    sign: str
    label: Callable[[Column], Column]
    base: Callable[[Column], Column]


def _varied(value: Column) -> Column:
    """Random keys have letters and digits, and have eight kinds of characters or half as many as they are long."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= F.least(F.lit(8), F.length(value) / 2))


def mod97(hit: Column) -> Column:
    """Whether an account number passes its check: the first four characters go last, letters count from 10, the rest by 97 is 1."""
    plain = F.regexp_replace(hit, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))
    code = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((F.when(c <= "9", a * 10).otherwise(a * 100) + code(c)) % 97))
    return rest == 1


_never = lambda h: F.lit(False)
GENERATORS = (
    Generator("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+)*+", r"@|[(\[{]at[)\]}]", lambda h: h.rlike("[.@]|dot") & h.rlike(r"(?:\.|dot.) ?[A-Za-z]{2,}$"), lambda h: h.rlike(EMAIL.replace(r"|\G", ""))),
    Generator("phone", r"(?<![0-9A-Za-z.+])\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])", "[0-9]", lambda h: h.rlike(r"[+(]") & _phone(h), lambda h: h.rlike(r"^\+[0-9]") & _phone(h)),
    Generator("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", "[0-9]{4}", _card, _card),
    Generator("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", "[0-9][.]", _ip, _ip),
    Generator("secret", r"(?i)(?<![A-Za-z])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth)\"? {0,3}[=:] {0,3}[\"']?[A-Za-z0-9+/_.-]{4,}+[\"']?", "[=:]", lambda h: let(F.regexp_extract(h, r"[=:] *[\"']?([^\"']*)", 1), lambda v: (F.length(v) >= 8) & _varied(v)), _never),
    Generator("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+", "[0-9]", _varied, _never),
    Generator("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, _never),
    Generator("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]-[0-9]", lambda h: ~h.rlike("^(?:000|666|9)"), _never),
)
CONTEXT = r"(?i)(?:mail|contact|call|tel|phone|fax|mobile|card|visa|pay|server|host|addr|key|token|pass|secret|iban|account|ssn|social)"
#: Features of a cell: name and number of values. Together they fit an int.
FEATURES = (("generator", len(GENERATORS)), ("length", 16), ("digits", 16), ("letters", 5), ("separators", 8), ("left", 4), ("right", 4), ("context", 2))
CANDIDATE = "array<struct<start:int,kind:int,end:int,cell:int,label:boolean,base:boolean>>"


def _side(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[A-Za-z0-9]"), 2).otherwise(3)


def _cell(g: int, hit: Column, left: Column, right: Column) -> Column:
    digits, letters = F.length(_digits(hit)), F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))
    values = (
        F.lit(g),
        F.least(F.lit(15), F.floor(F.length(hit) / 3)),
        F.least(F.lit(15), F.floor((digits + 1) / 2)),
        F.floor(letters * 4 / F.length(hit)),
        F.least(F.lit(7), F.length(hit) - digits - letters),
        _side(F.right(left, F.lit(1))),
        _side(right),
        left.rlike(CONTEXT).cast("int"),
    )
    cell = F.lit(0)
    for v, (_, n) in zip(values, FEATURES, strict=True):
        cell = cell * n + v
    return cell.cast("int")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_candidates``: every generator's spans with their cell, weak label and whether a base kind holds them."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for g, made in enumerate(GENERATORS):

        def make(s: Column, e: Column, h: Column, left: Column, right: Column, g: int = g, made: Generator = made) -> Column:
            return F.struct(s.alias("start"), F.lit(KINDS.index(made.kind)).alias("kind"), e.alias("end"), _cell(g, h, left, right).alias("cell"), F.coalesce(made.label(h), F.lit(False)).alias("label"), F.coalesce(made.base(h), F.lit(False)).alias("base"))

        parts.append(F.when(t.rlike(made.sign), located(t, made.pattern, make, CANDIDATE)).otherwise(F.expr(f"cast(array() as {CANDIDATE})")))
    return docs.withColumn("_candidates", F.concat(*parts))


def selected_cells(found: DataFrame, precision: float = PRECISION) -> list[int]:
    """Cells whose boosted score reaches the calibrated threshold of their kind.

    ``found`` has ``_candidates`` and ``_half`` (whether a text is in the half that trees learn from; equal texts are in
    the same one). All candidates are counted by cell, label and half. Where a half has no candidates the other one takes
    its place; where it has one label only, no tree is fitted: all cells are selected if every label is positive, none
    if none is.
    """
    counted = found.select("_half", F.explode("_candidates").alias("c")).groupBy("c.cell", "c.kind", "c.label", "_half").agg(F.count(F.lit(1)).alias("n"))
    features, rest = [], F.col("cell")
    for name, n in reversed(FEATURES):
        features.append((name, (rest % n).cast("double")))
        rest = F.floor(rest / n)
    # a row for each cell that occurs, label and half: bounded by the grid, whatever the documents
    cells = stored(counted.coalesce(1).withColumns(dict(features)).withColumn("target", F.col("label").cast("double")).withColumn("weight", F.sqrt("n")), "cells")
    halves = {r[0] for r in cells.select("_half").distinct().collect()}
    learned = cells.filter(F.col("_half") == (True in halves))
    labels = {r[0] for r in learned.select("label").distinct().collect()}
    if labels != {True, False}:
        return [r[0] for r in cells.select("cell").distinct().collect()] if labels == {True} else []
    assembler = VectorAssembler(inputCols=[n for n, _ in FEATURES], outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="target", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.5, maxBins=16, seed=7).fit(assembler.transform(learned))
    scored = [tuple(r) for r in trees.transform(assembler.transform(cells)).select("cell", "kind", "label", "_half", "n", F.round(vector_to_array("probability")[1], 6).alias("score")).collect()]
    threshold = calibrate([(k, label, n, score) for _, k, label, half, n, score in scored if half == (False not in halves)], precision)
    return sorted({cell for cell, k, *_, score in scored if score >= threshold.get(k, 2.0)})


def calibrate(scored: list[tuple[int, bool, int, float]], precision: float) -> dict[int, float]:
    """A threshold for each kind of (kind, label, count, score): the lowest score at which the labels confirm ``precision``
    of all hits from there up, and MARGIN of those that lowering the threshold to it adds."""
    out = {}
    for kind in {r[0] for r in scored}:
        own = sorted((r for r in scored if r[0] == kind), key=lambda r: -r[3])
        good = total = taken_good = taken = 0
        for i, (_, label, n, score) in enumerate(own):
            good, total = good + n * label, total + n
            if (i + 1 == len(own) or own[i + 1][3] < score) and good >= precision * total and good - taken_good >= MARGIN * (total - taken):
                out[kind], taken_good, taken = score, good, total
    return out


def personal_data(docs: DataFrame, text: str = "text", precision: float = PRECISION, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of start, kind, end; kind an index into ``KINDS``) to every row.

    ``keep`` names the columns of ``docs`` that the result needs (all by default); they are stored with the candidates.
    Spans are sorted by start, then kind; ``spans`` holds the base ones and the selected candidates that no base kind
    already holds. Null and empty texts have none. Very long texts are treated whole. Columns of ``docs`` that are named
    ``spans``, ``base_spans`` or start with one of the working names (``_candidates``, ``_half``, ``_email`` ...) are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "base_spans", "_candidates", "_half", *(f"_{k}" for k in BASE_KINDS))]
    scanned = candidates(with_base(docs, text), text).withColumn("_half", F.pmod(F.xxhash64(text), F.lit(2)) == 0)
    found = stored(scanned.select(*kept, *(f"_{k}" for k in BASE_KINDS), "_candidates", "_half"), "candidates")
    cells = selected_cells(found, precision)
    chosen = lambda c: c["cell"].isin(cells) if cells else F.lit(False)
    more = F.transform(F.filter("_candidates", lambda c: ~c["base"] & chosen(c)), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    base = F.concat("_email", "_ip", "_card", "_phone")
    return (
        found.withColumn("base_spans", F.array_sort(base))
        .withColumn("spans", F.when(F.size("_candidates") == 0, F.array_sort(base)).otherwise(F.array_sort(F.array_distinct(F.concat(base, more)))))
        .drop("_candidates", "_half")
    )


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch of (overlapping) spans replaced by one ``[KIND]``, the kind of its first span."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    stretch = "array<struct<start:int,kind:int,end:int>>"
    merged = F.aggregate(
        spans,
        F.expr(f"cast(array() as {stretch})"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["start"]),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.element_at(a, -1)["kind"].alias("kind"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(s))),
    )
    return F.when(
        F.size(spans) > 0,
        let(
            merged,
            lambda m: F.concat(
                F.array_join(
                    F.transform(
                        m,
                        lambda s, i: let(
                            F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0),
                            lambda before: F.concat(F.substring(text, before + 1, s["start"] - before), F.lit("["), F.get(names, s["kind"]), F.lit("]")),
                        ),
                    ),
                    "",
                ),
                F.substring(text, F.element_at(m, -1)["end"] + 1, F.char_length(text)),
            ),
        ),
    ).otherwise(text)


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every document."""
    found = personal_data(docs.select("doc_id", "text"), keep=("doc_id",))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

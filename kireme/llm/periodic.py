"""Periodic runs of words: stretches that repeat themselves at least twice with one period, found by a scan over all lags.

Words become numbers, and a text's numbers are compared with themselves shifted by each lag q up to half of its words;
a true stretch of m comparisons is a stretch of m + q words with period q. A run must have ``least = max(q, shortest - q)``
true comparisons in a row, so comparing hashes of four words at every ``least - 3``-th place can miss none: lags
at which no place agrees are done with that, the others are compared in full where a place agrees, and the true stretches are
run-length coded. Texts of a batch are compared together, a text's words having numbers of their own.

A stretch found under a multiple of its period is the same stretch (the theorem of Fine and Wilf), so it is counted once,
under the smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kireme.functions.arrays import let
from kireme.llm.storage import raw, stored

SHORTEST = 12
"""words of the shortest run"""
GRAM = 4
#: Words that are compared together; a longer text is compared alone.
TOGETHER = 1 << 20
#: Texts of more bytes have their lags dealt over tasks, in RANGES ranges. Results are the same either way.
DEALT_BYTES = 4 << 20
RANGES = 32
RUNS = "array<struct<start:long,length:long,period:long>>"


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


class _Known:
    """Runs found so far, by period: places inside one agree under every multiple of its period and say nothing new."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.periods = np.zeros(0, np.int64)

    def add(self, start: int, end: int, period: int) -> None:
        if period not in self.runs:
            self.runs[period] = []
            self.periods = np.append(self.periods, period)
        self.runs[period].append((start, end))
        self.sorted.pop(period, None)

    def covers(self, start: np.ndarray, end: np.ndarray, lag: int) -> np.ndarray:
        """Whether words [start, end) lie inside a run whose period divides the lag."""
        out = np.zeros(len(start), bool)
        for d in self.periods[lag % self.periods == 0].tolist():
            if d not in self.sorted:
                # runs of one period that start later end later
                self.sorted[d] = tuple(np.array(sorted(self.runs[d]), np.int64).T)
            starts, ends = self.sorted[d]
            k = np.searchsorted(starts, start, "right") - 1
            out |= (k >= 0) & (ends[np.maximum(k, 0)] >= end)
        return out


def _stretches(ids: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(first, end) of each stretch of at least ``least`` places where the numbers agree with those ``lag`` later."""
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[:-lag] == ids[lag:]
    turns = np.flatnonzero(np.diff(same))
    long = turns[1::2] - turns[::2] >= least
    return zip(turns[::2][long].tolist(), turns[1::2][long].tolist(), strict=True)


def _smallest_period(ids: np.ndarray, start: int, lag: int) -> int:
    """The smallest period of a stretch of at least twice the length ``lag``, which is a period of it."""
    d = lag
    for p in _prime_factors(lag):
        while d % p == 0 and np.array_equal(ids[start : start + lag], ids[start + d // p : start + lag + d // p]):
            d //= p
    return d


def scan(ids: np.ndarray, at: np.ndarray, shortest: int = SHORTEST, first: int = 1, last: int | None = None) -> np.ndarray:
    """Rows (start, length, period) of all runs that the lags from ``first`` to ``last`` (None: all) show.

    ``ids`` has the numbers of several texts' words, no number in two texts; text k has those from ``at[k]`` to
    ``at[k + 1]``, and texts are ordered from the longest on. A start is counted from the first number of ``ids``.
    """
    sizes = np.diff(at)
    key = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    gram = key[: max(0, len(key) - GRAM + 1)].copy()
    for k in range(1, GRAM):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + key[k : len(key) - GRAM + 1 + k]
    known, found, alive = _Known(), [], len(sizes)
    top = int(sizes[0]) // 2 if len(sizes) else 0
    for q in range(first, min(top, last or top) + 1):
        while alive and sizes[alive - 1] < max(2 * q, shortest):
            alive -= 1
        if not alive:
            break
        end, least = int(at[alive]), max(q, shortest - q)
        wide = GRAM if least >= GRAM else 1
        side = gram if wide == GRAM else ids
        step = least - wide + 1
        stop = end - q - wide + 1
        hit = np.flatnonzero(side[:stop:step] == side[q : q + stop : step]) * step if stop > 0 else np.zeros(0, np.int64)
        if hit.size and known.periods.size:
            hit = hit[~known.covers(hit, hit + q + wide, q)]
        for text in np.unique(np.searchsorted(at, hit, "right") - 1).tolist():
            lo, hi = int(at[text]), int(at[text + 1])
            for a, b in _stretches(ids[lo:hi], q, least):
                a, b = a + lo, b + lo + q
                if known.covers(np.array([a]), np.array([b]), q)[0]:
                    continue
                d = _smallest_period(ids, a, q)
                known.add(a, b, d)
                found.append((a, b - a, d))
    return np.array(found, np.int64).reshape(-1, 3)


def _batches(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray, np.ndarray]]:
    """Rows of texts that are compared together (longest first), their words, and the words' numbers and bounds."""
    rows: list[int] = []
    words: list[list[bytes]] = []
    n = 0
    for r in range(len(texts) + 1):
        if rows and (r == len(texts) or n >= TOGETHER):
            order = sorted(range(len(rows)), key=lambda k: -len(words[k]))
            rows, words = [rows[k] for k in order], [words[k] for k in order]
            at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
            ids = np.repeat(np.arange(len(rows), dtype=np.int64) << 32, np.diff(at)) | flat
            yield rows, words, ids, at
            rows, words, n = [], [], 0
        if r < len(texts):
            # what bytes.split parts at is exactly the blank and \x09-\x0D
            rows.append(r), words.append((texts[r] or b"").split())
            n += len(words[-1])


def _answer(words: list[bytes], runs: np.ndarray) -> tuple[list[dict], bytes]:
    """Runs in order, and the text without the repeats: of each run only the first period stays."""
    if not len(runs):
        return [], b" ".join(words)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(dropped)[:-1] == 0
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _batch(key: pa.Array, n: list[int], runs: list[list[dict]], collapsed: list[bytes]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary())], ["key", "n_words", "runs", "collapsed"])


def _whole(docs: DataFrame, shortest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, ids, at in _batches([*raw(batch.column(1))]):
                found = scan(ids, at, shortest)
                text = np.searchsorted(at, found[:, 0], "right") - 1
                found[:, 0] -= at[text]
                order = np.argsort(text, kind="stable")
                found, cut = found[order], np.searchsorted(text[order], np.arange(len(rows) + 1))
                made = [_answer(w, found[cut[k] : cut[k + 1]]) for k, w in enumerate(words)]
                yield _batch(batch.column(0).take(pa.array(rows, pa.int64())), [len(w) for w in words], [r for r, _ in made], [c for _, c in made])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed binary")


def _dealt(docs: DataFrame, shortest: int) -> DataFrame:
    """As ``_whole``, the lags of each text dealt over RANGES tasks and the runs they show put together by text."""
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "runs")
    ranges = rows.select("row", "text", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("part")).repartition("row", "part")

    def lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (text, part) in enumerate(zip(raw(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                ((_, _, ids, at),) = _batches([text])
                top = len(ids) // 2
                found = scan(ids, at, shortest, 1 + top * part // RANGES, top * (part + 1) // RANGES) if top * part // RANGES < top * (part + 1) // RANGES else np.zeros((0, 3), np.int64)
                row = batch.column(0).take(pa.array([r] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([row, *(pa.array(found[:, k]) for k in range(3))], ["row", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, n = [], []
            for text, runs in zip(raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                made.append(_answer(words, np.array([[x["start"], x["length"], x["period"]] for x in runs or []], np.int64).reshape(-1, 3)))
            yield _batch(batch.column(0), n, [r for r, _ in made], [c for _, c in made])

    # a text has fewer runs than words
    runs = ranges.select("row", "text", "part").mapInArrow(lags, "row long, start long, length long, period long").groupBy("row").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    joined = rows.join(runs, "row", "left").select("key", "text", "runs")
    return joined.mapInArrow(finish, f"key {docs.schema['key'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed binary")


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``key``, n_words, runs (start, length and period in words, by start and period) and the collapsed text of every row.

    Words are what blanks and \\x09-\\x0D part; a run is at least ``shortest`` words and two periods long, has no smaller
    period, and no word beside it carries the period on. Collapsing drops each word that some run holds after the run's first
    period, and joins the rest by one blank. Null and empty texts have no words, no runs and an empty collapsed text.
    Keys may repeat or be null, rows are judged by themselves; other columns do not matter. Bytes that are no UTF-8
    stay as they are (``collapsed`` is cast from them).
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.coalesce(F.octet_length("text") > DEALT_BYTES, F.lit(False))
    found = _whole(rows.filter(~long), shortest).unionByName(_dealt(rows.filter(long), shortest))
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(text: Column, number: Column) -> Column:
    """The contract's texts: in every tenth document the words from some place on repeat with a period given by its id.

    A null id plants nothing.
    """
    h = F.crc32(number.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % period).cast("int"))))

    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & text.rlike(r"[^ \t-\r]"), let(words, lambda w: F.array_join(repeated(w), " "))).otherwise(text)


def run_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns over ``documents`` (doc_id, text)."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.l")).alias("length"), F.col("_best.p").alias("period"),
        F.floor(-1000 * F.col("_best.l") / F.col("_best.p")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

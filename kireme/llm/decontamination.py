"""Benchmark decontamination with one Aho-Corasick automaton over the windows of normalised test items.

Items are cut into windows of ten consecutive words (a shorter item is one window). Words of the benchmark get numbers,
windows become number sequences, and one automaton over all of them scans the words of each document once; a hit's
place leads back to word positions and, through the words' own offsets, to the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kireme.llm.storage import raw
from kireme.operators.workers import once

#: Words in UTF-8: every byte of a character beyond ASCII belongs to one.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes as they are compared: A-Z lower-cased, all others outside words turned into blanks.
PLAIN = bytes(c if re.match(WORD, bytes([c])) else 0x20 for c in bytes(range(256)).lower())
WINDOW = 10
#: Characters of item texts behind one automaton. A larger benchmark is scanned block by block.
BLOCK_CHARS = 4_000_000
#: Bytes of document text that a task holds for a round of all blocks, if there are several.
HELD_BYTES = 32_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


class Automaton:
    """All windows of some items. ``match`` gives the words hit and the items found."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in owners.items():
            self.trie.add_word(key, (len(key), sorted(found, key=str)))
        if owners:
            self.trie.make_automaton()
        self.empty = not owners

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Spans (first word, word after the last) of all occurrences, and the items that own them."""
        if self.empty or not words:
            return np.zeros((0, 2), np.int64), set()
        ids = tuple([*map(self.number.get, words, repeat(0))])
        spans, items = [], set()
        for end, (n, found) in self.trie.iter(ids):
            spans.append((end + 1 - n, end + 1))
            items.update(found)
        return np.array(spans, np.int64).reshape(-1, 2), items


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list]:
    """The items in blocks of bounded size, read one at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary")).filter(F.length("text") > 0).toLocalIterator():
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def _chunks(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at least ``size`` bytes of text, the last one less."""
    part, held = [], 0
    for batch in batches:
        part.append(batch)
        held += batch.column(text).nbytes
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, offsets: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: its columns ``carry``, n_words, n_hit, items (sorted strings of item ids); with ``offsets`` also ``full`` and ``spans``.

    ``spans`` lists the hit stretches as start and end code points of the original text, ``full`` tells whether a whole
    window of an item occurs (not only items shorter than one). A task holds one automaton at a time, of at most
    ``block_chars`` characters of item text (and one item). Rows are held against all blocks in turn where they are, and
    their hits united before stretches are made, so that neither ids nor the number of blocks change a result. Null
    texts have no words; items without words match nothing. Texts are compared by their bytes, so invalid UTF-8 does no
    harm; ``spans`` count code points of valid text.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in _blocks(benchmark, block_chars)]
    # with several blocks, each automaton is built anew for so many bytes of text
    held = HELD_BYTES if len(shared) > 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for part in _chunks(batches, len(carry), held):
            texts = [t for batch in part for t in raw(batch.column(len(carry)))]
            n = len(texts)
            n_words, full, on, owners = np.zeros(n, np.int64), np.zeros(n, bool), [None] * n, [()] * n
            for block in shared:
                if len(shared) == 1:
                    automaton = once(block, lambda items: Automaton(items, window))
                else:
                    automaton = None  # frees the last one first
                    automaton = Automaton(block.value, window)
                for i, t in enumerate(texts):
                    words = words_of(t)
                    n_words[i] = len(words)
                    spans, found = automaton.match(words)
                    if len(spans):
                        mask = covered(spans, len(words))
                        on[i] = mask if on[i] is None else on[i] | mask
                        owners[i] = found.union(owners[i])
                        full[i] |= bool((spans[:, 1] - spans[:, 0] == window).any())
            at = 0
            for batch in part:
                rows = range(at, at + len(batch))
                at += len(batch)
                columns = [batch.column(i) for i in range(len(carry))]
                columns += [pa.array(n_words[rows.start : rows.stop]), pa.array([0 if on[i] is None else int(on[i].sum()) for i in rows], pa.int64()), pa.array([sorted(map(str, owners[i])) for i in rows], pa.list_(pa.string()))]
                if offsets:
                    stretches = [[] if on[i] is None else _stretches(texts[i], np.flatnonzero(on[i])) for i in rows]
                    columns += [pa.array(full[rows.start : rows.stop]), pa.array(stretches, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = "n_words long, n_hit long, items array<string>" + (", full boolean, spans array<struct<start:int,end:int>>" if offsets else "")
    fields = T.StructType([docs.schema[c] for c in carry] + T.StructType.fromDDL(more).fields)
    names = fields.names
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, fields)


def _stretches(text: bytes, on: np.ndarray) -> list[dict]:
    """Code point ranges of runs of hit words in the original text."""
    out: list[dict] = []
    places = [m.span() for m in WORD.finditer(text.lower())]
    # code points before each byte
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    last = -2
    for i in on.tolist():
        end = int(points[places[i][1]])
        if i == last + 1:
            out[-1]["end"] = end
        else:
            out.append({"start": int(points[places[i][0]]), "end": end})
        last = i
    return out


def without(text: Column, spans: Column) -> Column:
    """The text without the given stretches (start, end), each replaced by one space."""
    pieces = F.transform(spans, lambda s, i: F.substring(text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)))
    return F.concat_ws(" ", pieces, F.substring(text, F.element_at(spans, -1)["end"] + 1, F.char_length(text)))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT k, i, n, item FROM dw JOIN bw USING (n, s)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

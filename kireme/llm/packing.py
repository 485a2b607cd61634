"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Lengths lie between 1 and the capacity, so packing is planned on the histogram of lengths: one sequence pattern is made
greedily (longest first, then the longest that fits), its smallest document is exchanged for the two unpacked ones that
fill the wider gap best, and the pattern is used as often as the histogram allows. The plan's size depends on the
capacity alone, whatever the number of documents, and packs all of them together rather than block by block. Documents
then take their places by their rank in the order of length, found by one range shuffle of rows without texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import ranked, raw, stored
from kireme.operators.workers import once

CAPACITY = 2048
END_ID = 0
#: Distinct blank-separated chunks whose ids a worker remembers before it starts anew (a single text may add more).
REMEMBERED = 800_000
#: Chunks longer than this are encoded each time.
CHUNK_CHARS = 64
#: A chunk of lower-case letters that no normalisation changes.
WORD = re.compile("[a-zß-öø-ÿ]+")
#: A dot or comma between a letter and a blank.
STOP = re.compile(r"(?<=[a-z])([.,])(?= )")


#: Texts that a vocabulary must encode alike whole and in chunks before chunks are used.
PROBES = ("The dog's, 3.5. (a)... X", "a,b. c, d.\n\nE\tf  g", "Été ß. naïve, ÀB’s \u3000日本. x,, y.", "1. 2, l'an. ab12. cd,")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    # tasks are the parallelism: threads of its own would only contend for their cores
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    moved = {b: 256 + i for i, b in enumerate(others)}
    return [chr(moved.get(b, b)) for b in range(256)]


class _Chunks(dict):
    """Ids of chunks, encoded when they are first asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.letters = tokenizer, byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if WORD.fullmatch(chunk):
            # one word: there is nothing to normalise or part, so the model alone gives its ids
            ids = [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in chunk.encode()]))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        found = np.asarray(ids, "<u4").tobytes()
        if len(chunk) <= CHUNK_CHARS:
            self[chunk] = found
        return found


class _Encoder:
    """Ids of whole texts through ids of their blank-separated chunks.

    A vocabulary that lower-cases, drops white space, never joins across it and keeps letters apart from stops gives a
    text the ids of its chunks in order. Whether it does is read from its definition and tried on ``PROBES``; any other
    vocabulary encodes each text whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known = _Chunks(self.tokenizer)
        made = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        parts = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        self.chunked = bool("Lowercase" in kinds and parts and [x["type"] for x in rest] == ["ByteLevel"])
        self.chunked = self.chunked and all(np.array_equal(self.ids(t.encode()), self.whole(t)) for t in PROBES)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not self.chunked:
            return self.whole(text.decode("utf-8", "replace"))
        # a letter never joins a dot or comma: fewer kinds of chunks are left
        chunks = STOP.sub(r" \1", text.lower().replace(b"\n", b" ").decode("utf-8", "replace")).split(" ")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), "<u4")


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length and ids (binary, little-endian unsigned 32-bit).

    A document's ids are those of its whole text (null: empty) and a closing id 0; only longer ones are cut, into
    pieces of ``capacity`` ids of which the last may be shorter. ``tokenizer_path`` must exist on every worker, which
    keeps what it has encoded for its later tasks (REMEMBERED chunks, some 250 MB). Bad bytes of invalid UTF-8 count as
    replacement characters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(shared, _Encoder)
        for batch in batches:
            ids_of, texts = batch.column(0), [*raw(batch.column(1))]
            for at in range(0, len(batch), 256):
                rows, piece, start, length, ids = [], [], [], [], []
                for r in range(at, min(at + 256, len(batch))):
                    all_ids = np.append(encoder.ids(texts[r]), np.uint32(END_ID)).astype("<u4")
                    for k, s in enumerate(range(0, len(all_ids), capacity)):
                        part = all_ids[s : s + capacity]
                        rows.append(r), piece.append(k), start.append(s), length.append(len(part)), ids.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Patterns (first sequence, repetitions, [(length, uses)]) that use every counted length exactly.

    ``counts`` has at most ``capacity`` lengths, from 1 to ``capacity``.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")
        left[length] = n
    out, first = [], 0
    while (have := np.flatnonzero(left)).size:
        bin_, gap = [], capacity
        free = left.copy()
        while gap > 0:
            fit = have[: np.searchsorted(have, gap, "right")]
            fit = fit[free[fit] > 0]
            if not fit.size:
                break
            best = int(fit[-1])
            n = int(min(free[best], gap // best))
            bin_.append([best, n])
            free[best] -= n
            gap -= n * best
        smallest = bin_[-1][0]
        if gap > 0 and (len(bin_) > 1 or bin_[0][1] > 1):
            # the smallest document goes back; the two that fill the wider gap best come in, if they fill more
            free[smallest] += 1
            wide = gap + smallest
            a = have[free[have] > 0]
            a = a[a < wide]
            if a.size:
                b_at = np.searchsorted(a, wide - a, "right") - 1
                ok = b_at >= 0
                a1, b1 = a[ok], a[b_at[ok]]
                # the same length twice needs two documents of it; else the next shorter one
                once = (a1 == b1) & (free[a1] < 2)
                b1 = np.where(once, a[np.maximum(b_at[ok] - 1, 0)], b1)
                a1, b1 = a1[b1 != a1 * once], b1[b1 != a1 * once]
                if a1.size:
                    k = int(np.argmax(a1 + b1))
                    if a1[k] + b1[k] > smallest:
                        bin_[-1][1] -= 1
                        bin_ += [[int(a1[k]), 1], [int(b1[k]), 1]]
        uses: dict[int, int] = {}
        for length, n in bin_:
            if n:
                uses[length] = uses.get(length, 0) + n
        times = min(int(left[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            left[length] -= times * n
        out.append((first, times, sorted(uses.items(), reverse=True)))
        first += times
    return out


def best_two_fit(pieces: DataFrame, *keys: str, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to every row, so that sequences hold ``capacity`` ids at most.

    ``keys`` should tell rows apart; equal rows take different places. Offsets in a sequence are gapless from 0. Other
    columns are carried along; ``sequence_id`` and ``offset`` of ``pieces`` are replaced, and names that start with an
    underscore are reserved.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    # at most ``capacity`` rows, whatever the input
    order = ranked(pieces, length, *keys, rank="_rank", name="pieces")
    counts = {int(r[0]): int(r[1]) for r in order.groupBy(length).agg(F.count(F.lit(1))).collect()}
    starts, total = {}, 0
    for n in sorted(counts):
        starts[n] = total
        total += counts[n]
    rows = []
    for first, times, uses in plan(counts, capacity):
        offset = 0
        for n, k in uses:
            rows.append((starts[n], n, k, first, offset))
            starts[n] += times * k
            offset += n * k
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            row = t[np.searchsorted(t[:, 0], rank, "right") - 1]
            local = rank - row[:, 0]
            yield batch.append_column("sequence_id", pa.array(row[:, 3] + local // row[:, 2])).append_column("offset", pa.array(row[:, 4] + local % row[:, 2] * row[:, 1]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order.schema.fields)
    return order.mapInArrow(place, f"{fields}, sequence_id long, offset long").drop("_rank")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its digest and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids themselves are not carried through the shuffle; ``sequences`` brings them to their places.
    Null and empty texts are one piece of the closing id. Repeated rows are packed as often as they come.
    """
    pieces = tokenised_pieces(docs, tokenizer_path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_two_fit(pieces, "doc_id", "piece", "ids_crc32", capacity=capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids, doc_ids, and ids (binary) in the order of their offsets.

    Texts are encoded once. Repeated rows are packed as often as they come.
    """
    whole = stored(tokenised_pieces(docs, tokenizer_path, capacity).withColumn("_row", F.monotonically_increasing_id()), "token-ids")
    places = best_two_fit(whole.select("_row", "length"), "_row", capacity=capacity).select("_row", "sequence_id", "offset")
    # a sequence holds ``capacity`` ids at most, so the groups are bounded
    joined = places.join(whole, "_row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_ids"), F.col("parts.doc_id").alias("doc_ids"), F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

"""Alignment of two tokenizers over the same bytes: common cuts, groups between them, linked tokens and how common each link is.

A worker encodes texts with both tokenizers and lays their tokens on one line of bytes: running
sums are the ends, ends that both have are cuts, and a search of the ends among the cuts tells a token's group.
Overlapping tokens are a stretch of tokens of the other side, so links come from repeating each token as often as its
stretch is long. A blank behind anything but white space is a cut of every text, so this is done for the units between
such cuts, once for each unit that a worker remembers, and a text has what its units have. Texts are dealt with in
blocks, which are stored once with their distinct pairs. How many documents hold a pair is summed in two
shuffles, by pair and salt and then by pair, and comes back to each block by its number: the shuffles carry a pair once
for each block and not for each document, so the most common pair has as many rows as there are blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kireme.llm.packing import byte_letters
from kireme.llm.storage import raw, stored
from kireme.operators.workers import once

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Units that a worker remembers before it keeps the more used half of them (one block may add more).
REMEMBERED = 250_000
#: Tokens of both sides that it remembers for a unit, on average.
UNIT_TOKENS = 16
SALTS = 16
#: The pieces in which byte-level vocabularies read a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From a blank to the next one that does not follow white space: pieces of neither side go on across that one.
UNITS = r" [^ ]*+(?:(?<=[\s\u180e]) [^ ]*+)*+"
#: Texts that a vocabulary must encode alike whole and in units before units are used.
PROBES = ("The dog's, 3.5. (a)...  X", " a,b. c, d.\n\n  E\tf  g ", "Été ß. naïve, ÀB’s 　日本. x   ", "ａ１ﬁ ½ \x00\x85 12 345")


def _spread(values: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The values of lists ``numbers``, one after the other; ``values`` holds all lists, ``sizes`` their lengths."""
    size = sizes[numbers]
    return values[np.arange(size.sum()) + np.repeat((np.cumsum(sizes) - sizes)[numbers] - (np.cumsum(size) - size), size)]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over neighbouring stretches of ``sizes`` values."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(sizes))])


class Sides:
    """Both tokenizers of a worker: ``a`` is a byte-level vocabulary file, ``b`` a piece model that adds a blank itself."""

    def __init__(self, paths: tuple[str, str]):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
        self.first.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.letters = byte_letters()
        n = self.first.get_vocab_size()
        a_bytes = [bytes([byte[c] for c in t]) if t and all(c in byte for c in t) else (t or "").encode() for t in map(self.first.id_to_token, range(n))]
        b_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_bytes, self.b_bytes = (np.frombuffer(b"".join(x), np.uint8) for x in (a_bytes, b_bytes))
        self.a_size, self.b_size = np.array([*map(len, a_bytes)], np.int64), np.array([*map(len, b_bytes)], np.int64)
        self.find = regex.compile(PIECES).findall
        self.tested: set[str] = set(map(chr, range(128)))
        self.unlike: set[str] = set()
        blank = self.second.piece_to_id("▁")
        self.blank = [blank]
        # no piece goes on across a blank, and whole texts agree: chunks from blank to blank may be encoded alone
        self.chunked = not any("▁" in self.second.id_to_piece(i).lstrip("▁") for i in range(len(b_bytes)))
        self.chunked = self.chunked and all(sum(self._second(re.findall(" +[^ ]*", f" {t}")), []) == self.second.encode(t) for t in PROBES)
        self.split = re.compile(UNITS).findall if self.chunked else lambda text: [text]
        # ids of groups as text, with what may come after them
        self.words = [f"{i}{s}" for s in (",", "|") for i in range(len(a_bytes))] + [f"{i}{s}" for s in (",", ";", "") for i in range(len(b_bytes))]
        self._restart()

    def _restart(self) -> None:
        """Forget all units. Of each: tokens of both sides, groups as text and by number, linked ids, blocks that used it, and whether both sides keep its bytes."""
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.a, self.b, self.links, self.n_a, self.n_b, self.n_groups, self.n_links, self.used = (np.zeros(0, np.int64) for _ in range(8))
        self.fits = np.zeros(0, bool)

    def _forget(self) -> None:
        """Forget the less used units if there are too many, or all if the others are too long; older use counts for less each time."""
        if len(self.number) > REMEMBERED:
            kept = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
            names = [*self.number]
            self.number = {names[k]: i for i, k in enumerate(kept.tolist())}
            self.groups = [self.groups[k] for k in kept.tolist()]
            self.a, self.b, self.links = (_spread(x, n, kept) for x, n in ((self.a, self.n_a), (self.b, self.n_b), (self.links, self.n_links)))
            self.n_a, self.n_b, self.n_groups, self.n_links, self.fits = (x[kept] for x in (self.n_a, self.n_b, self.n_groups, self.n_links, self.fits))
            self.used = self.used[kept] >> 1
        if len(self.a) + len(self.b) > UNIT_TOKENS * REMEMBERED:
            self._restart()

    def _second(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that begin with the blank which the model adds."""
        found = self.second.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
        return [self.blank if c == " " else ids for c, ids in zip(chunks, found, strict=True)]

    def _first(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and their number for each."""
        self._test(set("".join(u for u in units if not u.isascii())) - self.tested)
        pieces = [[u] if u.isascii() and u[1:].isalpha() else self._pieces(u) for u in units]
        flat = [p for x in pieces for p in x]
        number = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        letters, tokenize = self.letters, self.first.model.tokenize
        # printable ASCII is written as itself, but for the blank
        made = [[t.id for t in tokenize(p.replace(" ", letters[32]) if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode()]))] for p in number]
        size = np.fromiter(map(len, made), np.int64, len(made))
        at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        ids = _spread(np.array([i for x in made for i in x], np.int64), size, at)
        return ids, _sums(size[at], np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def _test(self, characters: set[str]) -> None:
        """Find characters whose class for the vocabulary's own splitter is not the pattern's."""
        for c in characters:
            probe = f"a{c}1{c}! "
            if self.find(probe) != [probe[s:e] for _, (s, e) in self.first.pre_tokenizer.pre_tokenize_str(probe)]:
                self.unlike.add(c)
        self.tested |= characters

    def _pieces(self, unit: str) -> list[str]:
        """Pieces as the vocabulary's own splitter makes them; it is asked where a character's class differs from the pattern's."""
        if self.unlike and not unit.isascii() and not self.unlike.isdisjoint(unit):
            return [unit[s:e] for _, (s, e) in self.first.pre_tokenizer.pre_tokenize_str(unit)]
        return self.find(unit)

    def _learn(self, units: list[str]) -> None:
        """Align units that were not met before."""
        a, n_a = self._first(units)
        # a unit may be long and hold blanks behind white space: the second side encodes from blank to blank
        chunks = [re.findall(" +[^ ]*", u) if self.chunked and u.find(" ", 1) > 0 else [u] for u in units]
        found = self._second([c for x in chunks for c in x])
        n_b = _sums(np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(map(len, chunks), np.int64, len(chunks)))
        b = np.array([i for x in found for i in x], np.int64)
        coded = [u.encode() for u in units]
        size, whole = np.fromiter(map(len, coded), np.int64, len(coded)), np.frombuffer(b"".join(coded), np.uint8)
        fits = np.ones(len(units), bool)
        for ids, n, sizes, token in ((a, n_a, self.a_size, self.a_bytes), (b, n_b, self.b_size, self.b_bytes)):
            same = _sums(sizes[ids], n) == size
            kept = _spread(token, sizes, ids[np.repeat(same, n)]) == whole[np.repeat(same, size)]
            fits &= same
            fits[same] &= _sums(~kept, size[same]) == 0
        a, b, n_a, n_b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)], np.where(fits, n_a, 0), np.where(fits, n_b, 0)
        x = aligned(a, n_a, self.a_size[a], b, n_b, self.b_size[b])
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.groups += self.group_texts(x)
        new = {"a": a, "b": b, "links": a[x.link_a] << 32 | b[x.link_b], "n_a": n_a, "n_b": n_b, "n_groups": x.n_groups, "n_links": np.bincount(x.link_text, minlength=len(units)), "used": np.zeros(len(units), np.int64), "fits": fits}
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the distinct units of all texts, the places of each text's units among them, and how many each text has: none if a side does not keep its bytes."""
        self._forget()
        split = [self.split(f" {t}") if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array([u for x in split for u in x], pa.large_string()).dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if new := [u for u in names if u not in self.number]:
            self._learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        self.used[numbers] += 1
        fits = _sums(~self.fits[numbers][at], n) == 0
        at, n = at[np.repeat(fits, n)], np.where(fits, n, 0)
        held = np.bincount(at, minlength=len(numbers)) > 0
        return numbers[held], (np.cumsum(held) - 1)[at], n

    def align(self, texts: list[str | None]) -> Alignment:
        distinct, at, n = self.units(texts)
        numbers = distinct[at]
        a, b = _spread(self.a, self.n_a, numbers), _spread(self.b, self.n_b, numbers)
        return aligned(a, _sums(self.n_a[numbers], n), self.a_size[a], b, _sums(self.n_b[numbers], n), self.b_size[b])

    def group_texts(self, x: Alignment) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text; empty without tokens."""
        last_a = np.append(x.a_group[1:] != x.a_group[:-1], True)[: len(x.a)]
        last_b = np.append(x.b_group[1:] != x.b_group[:-1], True)[: len(x.b)]
        after_b = last_b.astype(np.int64)
        after_b[(np.cumsum(x.n_b) - 1)[x.n_b > 0]] = 2
        n, m = len(self.a_size), len(self.b_size)
        out = np.empty(len(x.a) + len(x.b), np.int64)
        # a token stands behind all of its side before it and all of the other side in groups before it (or up to it)
        out[np.arange(len(x.a)) + np.searchsorted(x.b_group, x.a_group)] = x.a + n * last_a
        out[np.arange(len(x.b)) + np.searchsorted(x.a_group, x.b_group, "right")] = x.b + 2 * n + m * after_b
        at = np.concatenate([[0], np.cumsum(x.n_a + x.n_b)]).tolist()
        words = self.words
        return ["".join([words[k] for k in out[s:e].tolist()]) for s, e in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Alignment:
    """Tokens of several texts and their number for each text, groups (counted through all texts), and links."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: np.ndarray
    link_a: np.ndarray
    """place in ``a`` of each link's first token"""
    link_b: np.ndarray

    @property
    def link_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_a)), self.n_a)[self.link_a]


def aligned(a: np.ndarray, n_a: np.ndarray, a_size: np.ndarray, b: np.ndarray, n_b: np.ndarray, b_size: np.ndarray) -> Alignment:
    """Groups and links of texts that both sides cover with the same bytes; sizes are the tokens' bytes, none is 0."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    # the end of a text is a cut of both sides, so no group or link reaches into the next one
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    text_end = np.concatenate([[0], a_end])[np.cumsum(n_a)]
    n_groups = np.diff(np.concatenate([[0], np.searchsorted(cuts, text_end, "right")]))
    low, high = np.searchsorted(b_end, a_end - a_size, "right"), np.searchsorted(b_end - b_size, a_end, "left")
    n = high - low
    link_a = np.repeat(np.arange(len(a)), n)
    link_b = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    return Alignment(a, n_a, b, n_b, a_group, b_group, n_groups, link_a, link_b)


def _texts(column: pa.Array) -> list[str | None]:
    """Texts; None for null and for bytes that are no UTF-8, which no tokenizer keeps."""
    out: list[str | None] = []
    for value in raw(column):
        try:
            out.append(None if value is None else value.decode())
        except UnicodeDecodeError:
            out.append(None)
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts of a block at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        lo = 0
        column = _texts(batch.column(1))
        for r, t in enumerate(column):
            size += len(t or "") + 8
            if size >= BLOCK_BYTES or r + 1 == len(column):
                keys.append(batch.column(0).slice(lo, r + 1 - lo))
                texts += column[lo : r + 1]
                lo = r + 1
            if size >= BLOCK_BYTES:
                yield pa.concat_arrays(keys), texts
                keys, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(keys), texts


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, all lowest bytes first: neighbours are alike in the upper ones, which compresses."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, n_a, n_b, n_groups, groups, links) of every text: groups as ``a1,a2|b1;a3|b2,b3``, links as an array of (a, b), ids in order.

    A text that is null, empty, no UTF-8, or whose bytes one side does not keep, has zeros and empties.
    """
    shared = docs.sparkSession.sparkContext.broadcast((a_path, b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = once(shared, Sides)
        for keys, texts in _gathered(batches):
            x = sides.align(texts)
            pairs = pa.StructArray.from_arrays([pa.array(x.a[x.link_a], pa.int32()), pa.array(x.b[x.link_b], pa.int32())], ["a", "b"])
            at = np.concatenate([[0], np.cumsum(np.bincount(x.link_text, minlength=len(texts)))])
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups)), pa.array(sides.group_texts(x)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)], ["key", "n_a", "n_b", "n_groups", "groups", "links"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups string, links array<struct<a:int,b:int>>")
    return found.withColumnRenamed("key", key)


def _blocks(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Stored blocks: counts and group digests of their texts, their distinct pairs with the texts that hold them, and each text's pairs by place among these."""
    shared = rows.sparkSession.sparkContext.broadcast((a_path, b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, block = once(shared, Sides), TaskContext.get().partitionId() << 32
        for keys, texts in _gathered(batches):
            distinct, at, n = sides.units(texts)
            n_a, n_b, n_groups, n_links = (_sums(x[distinct][at], n) for x in (sides.n_a, sides.n_b, sides.n_groups, sides.n_links))
            # pairs are told apart among the block's distinct units, then go where their units occur
            pairs, of = np.unique(_spread(sides.links, sides.n_links, distinct), return_inverse=True)
            held, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * max(1, len(pairs)) + _spread(of, sides.n_links[distinct], at), return_counts=True)
            text, of = held // max(1, len(pairs)), held % max(1, len(pairs))
            holders = np.bincount(of, minlength=len(pairs))
            per_text = np.bincount(text, minlength=len(texts))
            first = np.append(True, text[1:] != text[:-1])[: len(of)]
            steps = of - np.where(first, 0, np.append(0, of[:-1])[: len(of)])
            names = sides.groups
            groups = [names[k] for k in distinct[at].tolist()]
            ends = np.cumsum(n).tolist()
            digests = [hashlib.sha256(";".join(groups[s:e]).encode()).hexdigest() if s < e else "" for s, e in zip([0, *ends], ends)]
            columns = [
                pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in (n_a, n_b, n_groups, n_links)),
                pa.array([digests], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.StructArray.from_arrays([pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(holders, pa.int64())], ["a", "b", "n"])),
                *(pa.array([_planes(v)], pa.binary()) for v in (per_text, steps, times)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "per_text", "steps", "times"])
            block += 1

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"block long, keys array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<struct<a:int,b:int,n:long>>, per_text binary, steps binary, times binary")
    return stored(made, "alignment")


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b and in how many texts they are linked: sums by pair and salt first, then by pair."""
    held = blocks.select("block", F.inline("pairs"))
    salted = held.groupBy("a", "b", (F.col("block") % SALTS).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """a, b and n: every pair of ids that some text links, and how many texts do."""
    return _pair_counts(_blocks(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), a_path, b_path))


def scored(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text.

    A pair counts in how many of ``docs`` it is linked; ``n_best`` are the links whose count is the highest of their first
    id (ties too), ``count_sum`` is the sum of the links' counts. Texts that are null, empty, no UTF-8 or not kept by a side
    have zeros and an empty digest; equal rows, equal or null keys and other columns don't matter, each row is a document.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = _blocks(rows, a_path, b_path)
    counts = stored(_pair_counts(blocks), "pairs")
    # one row per id of the first vocabulary at most
    top = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top")))
    marked = counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    back = blocks.select("block", F.posexplode("pairs").alias("at", "p")).select("block", "at", "p.a", "p.b").join(marked, ["a", "b"])
    # a block has as many pairs as its bounded text (or its one long text) links
    found = back.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("found"))
    both = blocks.drop("pairs").join(found.select("block", F.col("found.n").alias("n"), F.col("found.best").alias("best")), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x = dict(zip(batch.schema.names, (c.slice(r, 1) for c in batch.columns), strict=True))
                lists = {k: x[k].flatten() for k in ("keys", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n", "best")}
                per_text, steps, times = (_numbers(x[k][0].as_py()) for k in ("per_text", "steps", "times"))
                text = np.repeat(np.arange(len(per_text)), per_text)
                first = np.cumsum(per_text) - per_text
                run_up = np.cumsum(steps)
                # steps count from 0 in each text
                base = np.append(0, run_up)[first]
                of = run_up - np.repeat(base, per_text)
                n, best = lists["n"].to_numpy(zero_copy_only=False), lists["best"].to_numpy(zero_copy_only=False)
                total, hits = np.zeros(len(per_text), np.int64), np.zeros(len(per_text), np.int64)
                if len(of):
                    np.add.at(total, text, times * n[of])
                    np.add.at(hits, text, times * best[of])
                yield pa.RecordBatch.from_arrays([lists["keys"], lists["n_a"], lists["n_b"], lists["n_groups"], lists["n_links"], pa.array(hits), pa.array(total), lists["groups_sha256"]], ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = rows.schema["key"].dataType.simpleString()
    return both.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").withColumnRenamed("key", key)


def alignment_digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The contract's columns over ``documents`` (doc_id, text)."""
    return scored(docs, a_path, b_path).select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

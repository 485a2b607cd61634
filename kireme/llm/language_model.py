"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy over the whole corpus.

Every token is predicted from the tokens on both sides of it. The vectors of the
``SIDE`` tokens before and after a place are joined, pass one hidden layer, and a two-level softmax (class of the token,
then token in its class) gives its conditional probability. A document's score is the sum of the log-probabilities of
all its tokens.

Training is data-parallel: in each round every partition trains a copy of the shared parameters on its own documents,
and the copies are averaged by their tokens in a tree of bounded groups. What is gathered, word counts and parameter
copies, grows with the input.

Texts are read once, into blocks of documents: a block holds its distinct words with their counts, and each token as a
place in that list. So what is done by word (counts, ids, shares of rare words) is done once for each word of a block, on
Arrow's arrays of words; no word becomes a Python object again.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import decoded, stored
from kireme.operators.workers import once

WORD = re.compile(r"\w+|[^\w\s]")
#: Characters beyond ASCII that are no word's. In texts without them WORD's matches follow from bytes: 0 space, 1 in a word, 2 a token.
OTHER = re.compile(r"[^\x00-\x7F\w]")
KINDS = bytes(0 if chr(c).isspace() else 1 if re.match(r"\w", chr(c)) else 2 for c in range(128)) + bytes([1] * 128)
SPACES = bytes(c for c, kind in enumerate(KINDS) if not kind)
CLASSES, IN_CLASS = 48, 48
SIZE = CLASSES * IN_CLASS
#: A word that is at least this part of all tokens has an id of its own, and at least the SIZE most frequent ones do; larger
#: vocabularies take more classes and more words in each. The list that workers get thus has 30,000 words at most.
PART = 1 / 30_000
#: Ids kept for words outside the vocabulary, by hash; id 0 is the text's edge.
RARE = 63
DIMENSIONS, HIDDEN, SIDE = 8, 16, 2
ROUNDS, BATCH, RATE = 2, 8192, 0.1
#: Places that are scored at once; parameter copies that one task averages, and their bytes (two copies at least).
SCORED, FAN, AVERAGED = 8192, 32, 64_000_000
#: Tokens and documents that close a block (a longer document has a block of its own).
BLOCK = 1 << 20


def tokenized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of rows: block (unique), doc_ids and lengths of the rows, words (distinct), counts (tokens of each word), buckets (``_buckets`` of each word) and tokens.

    ``tokens`` holds the place of every token in ``words``: the lowest bytes of all places, then the next higher ones, and
    so on, as many as the places need. The table is stored, so that later passes read no texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), decoded(batch.column(1)), strict=True):
                block.add(doc_id, t)
                if block.size >= BLOCK:
                    yield block.row()
                    block = _Block()
        if block.size:
            yield block.row()

    blocks = docs.select("doc_id", text).mapInArrow(run, "doc_ids array<long>, lengths array<long>, tokens binary, words array<string>, counts array<long>, buckets binary")
    # pages of megabytes: Snappy's codec would keep direct buffers of that size for each, outside the heap
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), "token-blocks", "zstd")


def _planes(places: np.ndarray, words: int) -> bytes:
    used = max(1, (words.bit_length() + 7) // 8)
    return np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T[:used]).tobytes()


def _places(planes: pa.Scalar, n: int) -> np.ndarray:
    found = np.zeros((n, 4), np.uint8)
    if n:
        read = np.frombuffer(planes.as_buffer(), np.uint8).reshape(-1, n)
        found[:, : len(read)] = read.T
    return found.view("<u4").ravel()


def _buckets(words: pa.Array) -> np.ndarray:
    """The ids that words have outside the vocabulary: 1 to RARE."""
    found = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint32, len(words))
    return (1 + found % RARE).astype(np.uint8)


def _words(text: str | None) -> pa.Array:
    """WORD's matches in the lower-cased text."""
    text = text.lower() if text else ""
    if not text or OTHER.search(text):
        return pa.array(WORD.findall(text), pa.string())
    raw = text.encode()
    kinds = np.frombuffer(raw.translate(KINDS), np.uint8)
    word, first, last = kinds == 1, kinds == 2, kinds == 2
    first[0] |= word[0]
    last[-1] |= word[-1]
    first[1:] |= word[1:] > word[:-1]
    last[:-1] |= word[:-1] > word[1:]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw.translate(None, SPACES)))


class _Block:
    def __init__(self) -> None:
        self.doc_ids, self.lengths, self.words, self.size = [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = _words(text)
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.words.append(words)
        self.size += 1 + len(words)

    def row(self) -> pa.RecordBatch:
        # the chunks that hold tokens share one list of words, by first occurrence
        chunks = pa.chunked_array(self.words, pa.string()).dictionary_encode().chunks
        words = chunks[0].dictionary if chunks else pa.array([], pa.string())
        tokens = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in chunks)])
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.doc_ids], longs), pa.array([self.lengths], longs), pa.array([_planes(tokens, len(words))], pa.binary()), pa.ListArray.from_arrays([0, len(words)], words),
                pa.array([np.bincount(tokens, minlength=len(words))], longs), pa.array([_buckets(words).tobytes()], pa.binary()),
            ],
            ["doc_ids", "lengths", "tokens", "words", "counts", "buckets"],
        )


def word_counts(blocks: DataFrame) -> DataFrame:
    """w and n: how often each word occurs in all blocks."""
    return stored(blocks.select(F.inline(F.arrays_zip(F.col("words").alias("w"), F.col("counts").alias("c")))).groupBy("w").agg(F.sum("c").alias("n")), "word-counts")


def frequent(counts: DataFrame) -> list[str]:
    """The words that are PART of all tokens, but at least as many of the most frequent as the smallest network has ids for; ties by word."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(SIZE - RARE - 1, counts.filter(F.col("n") >= total * PART).count())
    return [r[0] for r in counts.orderBy(F.desc("n"), "w").limit(least).collect()]


def vocabulary(docs: DataFrame, text: str = "text") -> list[str]:
    """The ``frequent`` words of all documents."""
    return frequent(word_counts(tokenized(docs, text)))


def classes_for(words: list[str]) -> int:
    """Classes, and words in each, of a network with ids for ``words``."""
    return max(CLASSES, math.isqrt(len(words) + RARE) + 1)


class Tokens:
    def __init__(self, words: list[str]):
        self.words = pa.array(words, pa.string())

    def of(self, words: pa.Array, buckets: np.ndarray) -> np.ndarray:
        """Ids by word; a word outside the vocabulary has that of its bucket."""
        own = pc.index_in(words, self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(own < 0, buckets, RARE + 1 + own).astype(np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        words = _words(text)
        return self.of(words, _buckets(words))


def word_terms(blocks: DataFrame, counts: DataFrame, words: list[str]) -> DataFrame:
    """block and terms: place, id and log-probability within its bucket of each word of a block; 0 for those in ``words``.

    That probability is the word's count in the whole corpus over the count of its bucket. A block's list is as long as
    its distinct words.
    """
    known = blocks.sparkSession.createDataFrame([(w, RARE + 1 + i) for i, w in enumerate(words)], "w string, id int")
    rare = counts.join(F.broadcast(known), "w", "left_anti").withColumn("id", (1 + F.crc32(F.encode("w", "UTF-8")) % RARE).cast("int"))
    totals = rare.groupBy("id").agg(F.sum("n").alias("total"))
    shares = rare.join(F.broadcast(totals), "id").select("w", "id", F.ln(F.col("n") / F.col("total")).alias("share"))
    each = shares.unionByName(known.withColumn("share", F.lit(0.0)))
    placed = blocks.select("block", F.posexplode("words").alias("place", "w"))
    # a word is once in each, so a partition's hash table has its distinct words, and their places need no sort
    return placed.join(each.hint("shuffle_hash"), "w").groupBy("block").agg(F.collect_list(F.struct("place", "id", "share")).alias("terms"))


class _Placed:
    """A block's tokens as places in its list of words (``local``) and as ids, given those of its words."""

    def __init__(self, lengths: pa.Scalar, tokens: pa.Scalar, ids: np.ndarray):
        self.lengths = lengths.values.to_numpy()
        self.local = _places(tokens, int(self.lengths.sum()))
        self.ids = ids.take(self.local)
        # edges stand between the documents, SIDE of them
        self.at = np.arange(len(self.ids)) + np.repeat(SIDE * (np.arange(len(self.lengths)) + 1), self.lengths)
        self.padded = np.zeros(len(self.ids) + SIDE * (len(self.lengths) + 1), np.int32)
        self.padded[self.at] = self.ids

    def contexts(self, places: np.ndarray) -> np.ndarray:
        """``around`` the places, within each one's document."""
        return self.padded.take(self.at[places][:, None] + AROUND)

    def dealt(self, r: int, rounds: int) -> np.ndarray:
        """The places that ``dealt`` gives for each document."""
        skipped = (r + self.lengths) % rounds
        taken = (self.lengths - skipped + rounds - 1) // rounds
        first = np.cumsum(self.lengths) - self.lengths + skipped
        return np.repeat(first - rounds * (np.cumsum(taken) - taken), taken) + rounds * np.arange(taken.sum())

    def totals(self, values: np.ndarray) -> np.ndarray:
        """The sum of the tokens' ``values`` in each document."""
        # without any token the sums would be integers
        return np.bincount(np.repeat(np.arange(len(self.lengths)), self.lengths), values, len(self.lengths)).astype(np.float64)


def start(seed: int = 3, classes: int = CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = {
        "emb": rng.normal(0, 0.3, (classes * classes, DIMENSIONS)),
        "w1": rng.normal(0, 1 / np.sqrt(2 * SIDE * DIMENSIONS), (2 * SIDE * DIMENSIONS, HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "wc": rng.normal(0, 0.1, (HIDDEN, classes)),
        "bc": np.zeros(classes),
        "wt": rng.normal(0, 0.1, (classes, HIDDEN, classes)),
        "bt": np.zeros((classes, classes)),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in start()]).tobytes()


def unpack(raw: bytes, classes: int = CLASSES) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k, v in start(classes=classes).items():
        out[k] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return out


AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])


def around(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ids of the SIDE tokens before and after each place; edges are 0."""
    padded = np.concatenate([np.zeros(SIDE, np.int64), ids, np.zeros(SIDE, np.int64)])
    return padded[places[:, None] + SIDE + AROUND]


def _forward(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> tuple:
    """Context vectors, hidden layer with a last column of ones, and logits of all classes and of all words of each row's own class.

    Rows must be sorted by class, so that those of one class are a slice of every array.
    """
    classes = p["wc"].shape[1]
    v = p["emb"].take(context, axis=0).reshape(len(context), -1)
    h = np.ones((len(v), HIDDEN + 1), v.dtype)
    np.tanh(v @ p["w1"] + p["b1"], out=h[:, :HIDDEN])
    bounds = np.searchsorted(target % classes, np.arange(classes + 1))
    spans = [(c, bounds[c], bounds[c + 1]) for c in range(classes) if bounds[c] < bounds[c + 1]]
    both = np.empty((2, len(h), classes), h.dtype)
    # the biases are the weights of the ones
    np.matmul(h, np.concatenate([p["wc"], p["bc"][None]]), out=both[0])
    own = np.concatenate([p["wt"], p["bt"][:, None]], 1)
    for c, lo, hi in spans:
        np.matmul(h[lo:hi], own[c], out=both[1, lo:hi])
    # hidden values lie between -1 and 1, so the weights bound all logits; only large ones must be moved before exp
    if max(_reach(p["wc"], p["bc"], 0), _reach(p["wt"], p["bt"], 1)) > 60:
        both -= both.max(2, keepdims=True)
    return v, h, both, spans


def _by_class(target: np.ndarray, classes: int) -> np.ndarray:
    return np.argsort((target % classes).astype(np.uint16), kind="stable")


def _reach(weights: np.ndarray, bias: np.ndarray, hidden: int) -> float:
    """The largest absolute logit that hidden values between -1 and 1 can make."""
    return float((np.abs(weights).sum(hidden) + np.abs(bias)).max())


def log_probabilities(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(token | both sides) of each row."""
    classes = p["wc"].shape[1]
    order = _by_class(target, classes)
    own = target[order]
    both = _forward(p, context.take(order, axis=0), own)[2]
    rows, out = np.arange(len(own)), np.empty(len(own), both.dtype)
    found = both[0, rows, own % classes] + both[1, rows, own // classes]
    np.exp(both, out=both)
    out[order] = found - np.log(both @ np.ones(classes, both.dtype)).sum(0)
    return out


def train_step(p: dict[str, np.ndarray], memory: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step on a batch, in place."""
    n, classes = len(target), p["wc"].shape[1]
    order = _by_class(target, classes)
    context, target = context.take(order, axis=0), target[order]
    v, h, both, spans = _forward(p, context, target)
    for level in both:
        np.exp(level, out=level)
        level /= (level @ np.ones(classes, level.dtype))[:, None]
    rows = np.arange(n)
    both[0, rows, target % classes] -= 1
    both[1, rows, target // classes] -= 1
    d_h = both[0] @ p["wc"].T
    of_classes = h.T @ both[0]
    grads = {"wc": of_classes[:-1], "bc": of_classes[-1], "wt": np.zeros_like(p["wt"]), "bt": np.zeros_like(p["bt"])}
    for c, lo, hi in spans:
        part = both[1, lo:hi]
        d_h[lo:hi] += part @ p["wt"][c].T
        of_class = h[lo:hi].T @ part
        grads["wt"][c], grads["bt"][c] = of_class[:-1], of_class[-1]
    d_z = d_h * (1 - h[:, :HIDDEN] ** 2)
    grads["w1"], grads["b1"] = v.T @ d_z, d_z.sum(0)
    d_v = d_z @ p["w1"].T
    cells = context.reshape(-1, 1) * DIMENSIONS + np.arange(DIMENSIONS)
    grads["emb"] = np.bincount(cells.ravel(), d_v.ravel(), p["emb"].size).reshape(p["emb"].shape).astype(np.float32)
    for k, d in grads.items():
        # what has no gradient is left alone
        d /= n
        memory[k] += d * d
        p[k] -= rate * d / np.sqrt(memory[k] + 1e-8)


def _average(copies: DataFrame) -> bytes | None:
    """The mean of parameter copies (slot, weight, params), weighted.

    Copies are averaged in a tree. A group, which is one task, holds at most FAN copies and AVERAGED bytes (or two
    copies), whatever the number of partitions; with the smallest vocabulary a copy has some 0.2 MB.
    """

    copies = stored(copies, "parameters")
    highest, size = copies.agg(F.max("slot"), F.max(F.octet_length("params"))).first()
    if highest is None:
        return None
    fan = max(2, min(FAN, AVERAGED // size))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total, weight = None, 0.0
        for w, raw in zip(group["weight"], group["params"], strict=True):
            part = np.frombuffer(raw, np.float32) * np.float64(w)
            total = part if total is None else total + part
            weight += w
        return pd.DataFrame({"slot": [int(group["slot"].iloc[0]) // fan], "weight": [weight], "params": [(total / weight).astype(np.float32).tobytes()]})

    while highest:
        copies = stored(copies.groupBy(F.floor(F.col("slot") / fan).alias("g")).applyInPandas(merge, "slot long, weight double, params binary"), "parameters")
        highest //= fan
    return bytes(copies.first()["params"])


def dealt(n: int, r: int, rounds: int) -> np.ndarray:
    """The places of a text of ``n`` tokens that round ``r`` trains on; over all rounds each place is used once."""
    return np.arange((r + n) % rounds, n, rounds)


def train(blocks: DataFrame, words: list[str], rounds: int = ROUNDS, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters trained on every place of every document of ``tokenized`` blocks; without tokens the starting ones."""
    shared, classes = blocks.sparkSession.sparkContext, classes_for(words)
    vocabulary, params = shared.broadcast(words), pack(start(seed, classes))
    for r in range(rounds):
        known = shared.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], r: int = r, known=known) -> Iterator[pa.RecordBatch]:
            p, seen = unpack(known.value, classes), 0
            memory = {k: np.zeros_like(v) for k, v in p.items()}
            for batch in batches:
                for lengths, tokens, found, buckets in zip(*batch.columns, strict=True):
                    placed = _Placed(lengths, tokens, once(vocabulary, Tokens).of(found.values, np.frombuffer(buckets.as_py(), np.uint8)))
                    places = placed.dealt(r, rounds)
                    for at in range(0, len(places), BATCH):
                        some = places[at : at + BATCH]
                        train_step(p, memory, placed.contexts(some), placed.ids[some], RATE / (1 + r))
                    seen += len(places)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([pack(p)], pa.binary())], ["slot", "weight", "params"])

        params = _average(blocks.select("lengths", "tokens", "words", "buckets").mapInArrow(run, "slot long, weight double, params binary")) or params
    return unpack(params, classes)


def pseudo_likelihood(docs: DataFrame, words: list[str] | None = None, params: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_tokens, sum_logprob and mean_logprob of every row's whole text.

    Words and parameters are learned from ``docs`` unless given. A token outside the vocabulary has the probability of
    its hash bucket times its share of the bucket's tokens in ``docs``. A text without tokens (null, empty, blank) has sum and
    mean 0. Equal and repeated texts have equal scores. Bad bytes of invalid UTF-8 count as replacement characters.
    """
    blocks = tokenized(docs)
    counts = word_counts(blocks)
    words = frequent(counts) if words is None else words
    params = train(blocks, words) if params is None else params
    classes = params["wc"].shape[1]
    known = docs.sparkSession.sparkContext.broadcast(pack(params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpack(known.value, classes)
        for batch in batches:
            for doc_ids, lengths, tokens, terms in zip(*batch.columns, strict=True):
                # a block without tokens has no terms
                size = len(terms.values) if terms.is_valid else 0
                ids, share = np.zeros(size, np.int32), np.zeros(size)
                if size:
                    place = terms.values.field("place").to_numpy()
                    ids[place], share[place] = terms.values.field("id").to_numpy(), terms.values.field("share").to_numpy()
                placed = _Placed(lengths, tokens, ids)
                found = share.take(placed.local)
                # blocks are scored in parts, so that the arrays stay small
                for at in range(0, len(found), SCORED):
                    some = np.arange(at, min(at + SCORED, len(found)))
                    found[some] += log_probabilities(p, placed.contexts(some), placed.ids[some])
                yield pa.RecordBatch.from_arrays([doc_ids.values, lengths.values, pa.array(placed.totals(found))], ["doc_id", "n_tokens", "sum_logprob"])

    # neither texts nor words are shuffled with the blocks
    scored = blocks.select("block", "doc_ids", "lengths", "tokens").join(word_terms(blocks, counts, words), "block", "left").select("doc_ids", "lengths", "tokens", "terms").mapInArrow(run, "doc_id long, n_tokens long, sum_logprob double")
    return scored.withColumn("mean_logprob", F.when(F.col("n_tokens") > 0, F.col("sum_logprob") / F.col("n_tokens")).otherwise(0.0))

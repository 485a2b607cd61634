"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams: their vectors are averaged, and so are their attention values. A text
is the average of its words' vectors, each weighted by the exponential of its attention, and a linear softmax over that
average tells toxic from clean. Vectors, attention and softmax are trained together on whole texts, so that a few words
decide a long text where they should and are averaged away where they should not. Misspelt and unseen words share
n-grams, and so vectors and attention, with known ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import decoded
from kireme.operators.workers import once

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
DIMENSIONS = 8
#: Labelled documents that a model is fitted on at most, and the longest text among them.
TRAINING_ROWS = 4000
TRAINING_CHARS = 16_000
EPOCHS, BATCH, RATE = 6, 64, 0.5
#: A toxic document counts as so many clean ones.
TOXIC = 4.0
#: Weights in the average lie between exp(-ATTENTION) and exp(ATTENTION).
ATTENTION = 12.0
#: Words that a worker remembers, some 200 MB.
REMEMBERED = 700_000


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngrams(word: str) -> list[int]:
    """Buckets of a word's character n-grams of 3 to 5 with its edges, and of the whole word."""
    w = f"<{word}>"
    out = [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    out.append(zlib.crc32(b"=" + w.encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


class Model:
    """Vectors ``e`` and attention ``a`` of the buckets, softmax weights ``w`` (dimensions x 2) and bias ``b``."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.a = np.zeros(BUCKETS, np.float32)
        self.w = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.trained = False

    def weights(self) -> tuple:
        """What scoring needs: each bucket's part of the logit (the averages and the layer are linear) and its attention."""
        return (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), self.a, float(self.b[1] - self.b[0]), self.trained


class _Words(dict):
    """A word's weight in the average, and weight times part of the logit as the imaginary part, made when first asked for."""

    def __init__(self, part: np.ndarray, attention: np.ndarray):
        self.part, self.attention = part, attention

    def __missing__(self, word: str) -> complex:
        g = ngrams(word)
        weight = math.exp(min(max(float(self.attention[g].sum()) / len(g), -ATTENTION), ATTENTION))
        found = complex(weight, weight * float(self.part[g].sum()) / len(g))
        if len(self) < REMEMBERED:
            self[word] = found
        return found


class Scorer:
    def __init__(self, weights: tuple):
        part, attention, self.bias, self.trained = weights
        self.known = _Words(part, attention)

    def score(self, text: str | None) -> float:
        if not text or not self.trained:
            return 0.0
        both = sum(map(self.known.__getitem__, WORD.findall(text.lower())), 0j)
        return 1 / (1 + math.exp(-min(max(both.imag / both.real + self.bias, -30.0), 30.0))) if both.real else 0.0


def fit(texts: list[str], toxic: list[int], seed: int = 11) -> Model:
    """A model of labelled texts. Without both labels it stays untrained and scores 0."""
    model, rng = Model(seed), np.random.default_rng(seed)
    y = np.asarray(toxic, bool)
    if not y.any() or y.all():
        return model
    vocabulary: dict[str, int] = {}
    docs = [np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())], return_counts=True) for t in texts]
    filled = np.flatnonzero([len(d[0]) > 0 for d in docs])
    grams = [np.array(ngrams(w), np.int64) for w in vocabulary]
    size = np.array([len(g) for g in grams])
    flat, first = np.concatenate(grams), np.concatenate([[0], np.cumsum(size)])
    # attention starts at each n-gram's odds of toxic documents
    seen = np.ones((2, BUCKETS))
    for d, t in zip(docs, y, strict=True):
        if len(d[0]):
            seen[int(t), np.unique(np.concatenate([grams[i] for i in d[0]]))] += 1
    seen /= seen.max(1, keepdims=True)
    model.a[:] = 4 * np.log(seen[1] / seen[0]).clip(-2, 4)
    params = [model.e, model.a, model.w, model.b]
    memory = [np.full_like(p, 1e-6) for p in params]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(filled)
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            lens = np.array([len(docs[k][0]) for k in take])
            words, back = np.unique(np.concatenate([docs[k][0] for k in take]), return_inverse=True)
            counts, owner = np.concatenate([docs[k][1] for k in take]), np.repeat(np.arange(len(take)), lens)
            rows = np.concatenate([grams[i] for i in words])
            n, begin = size[words], np.concatenate([[0], np.cumsum(size[words])[:-1]])
            v = np.add.reduceat(model.e[rows], begin, 0) / n[:, None]
            s = np.add.reduceat(model.a[rows], begin) / n
            weight = np.exp(np.clip(s, -ATTENTION, ATTENTION))[back] * counts
            weight /= np.add.reduceat(weight, np.concatenate([[0], np.cumsum(lens)[:-1]]))[owner]
            mean = np.add.reduceat(v[back] * weight[:, None], np.concatenate([[0], np.cumsum(lens)[:-1]]), 0)
            z = mean @ model.w + model.b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            # labels are noisy: the targets stay off 0 and 1
            p -= np.where(y[take, None], [0.02, 0.98], [0.98, 0.02])
            g = p * np.where(y[take, None], TOXIC, 1) / len(take)
            d_mean = g @ model.w.T
            d_v = np.stack([np.bincount(back, d_mean[owner, k] * weight, len(words)) for k in range(DIMENSIONS)], 1) / n[:, None]
            d_s = np.bincount(back, weight * ((v[back] - mean[owner]) * d_mean[owner]).sum(1), len(words)) / n
            d_e = np.stack([np.bincount(rows, np.repeat(d_v[:, k], n), BUCKETS) for k in range(DIMENSIONS)], 1)
            # Adagrad; all parts move together
            for q, m, d in zip(params, memory, (d_e, np.bincount(rows, np.repeat(d_s, n), BUCKETS), mean.T @ g, g.sum(0)), strict=True):
                m += d**2
                q -= rate * d / np.sqrt(m)
    model.trained = True
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out ones, the first in the order of a hash of doc_id.

    An id with several labels counts as toxic if one says so. Rows that repeat an id are cut at ``rows`` too.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # the sample's size is a parameter, so it may be broadcast
    found = docs.select("doc_id", F.try_validate_utf8("text").alias("text")).filter(F.length("text") <= TRAINING_CHARS).join(F.broadcast(chosen), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "toxic").limit(rows).select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.3) to doc_id and held_out of every row.

    Null texts and texts without letters score 0. Scores depend on the text alone: repeated and equal texts score alike,
    and a text counts whole, whatever its length. In invalid UTF-8, bad bytes part words.
    """
    sample = training_rows(docs, labels, rows).toPandas().sort_values(["text", "toxic"])
    shared = docs.sparkSession.sparkContext.broadcast(fit(list(sample["text"]), list(sample["toxic"])).weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(shared, Scorer)
        for batch in batches:
            scores = [scorer.score(t) for t in decoded(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))

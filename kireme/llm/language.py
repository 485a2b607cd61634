"""Language identification by a byte convolutional network, trained in numpy.

Texts are lower-cased and cut into windows of a fixed number of bytes. Bytes have vectors; filters of several widths
slide over them, the largest response of each filter in the window is kept, and a softmax names the language. A
document's windows vote with their log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import decoded
from kireme.llm.toxicity import held_out

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 24
DIMENSIONS = 8
#: Labelled documents that a model is fitted on at most, the longest text among them, and the windows of each.
TRAINING_ROWS = 3000
TRAINING_CHARS = 16_000
TRAINING_WINDOWS = 4
EPOCHS, BATCH, RATE = 8, 128, 3e-3
#: Windows that are scored at once.
SCORED = 256
UNKNOWN = "und"


def windows(text: str, length: int = LENGTH) -> np.ndarray:
    """All windows of a text, one after the other; the last is filled with zeros (shorter texts make one)."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, length)


class Network:
    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        span = max(WIDTHS)
        self.languages = languages
        self.emb = rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32)
        self.emb[0] = 0
        # one matrix for all widths: filters of a smaller width have zeros behind it
        self.conv = rng.normal(0, 1, (span * DIMENSIONS, FILTERS * len(WIDTHS))).astype(np.float32)
        self.mask = np.zeros_like(self.conv)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * DIMENSIONS, k * FILTERS : (k + 1) * FILTERS] = 1
            self.conv[:, k * FILTERS : (k + 1) * FILTERS] *= np.sqrt(2 / (w * DIMENSIONS))
        self.conv *= self.mask
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.bias, self.out, self.out_bias]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, where it was, and the bytes' vectors under the filters."""
        span = max(WIDTHS)
        padded = np.pad(x, ((0, 0), (0, span - 1)))
        v = self.emb[padded]
        under = np.lib.stride_tricks.sliding_window_view(v, span, 1).transpose(0, 1, 3, 2).reshape(len(x) * x.shape[1], span * DIMENSIONS)
        response = (under @ self.conv).reshape(len(x), x.shape[1], -1)
        best = response.argmax(1)
        return np.take_along_axis(response, best[:, None], 1)[:, 0] + self.bias, best, under

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        span = max(WIDTHS)
        v = self.emb[np.pad(x, ((0, 0), (0, span - 1)))]
        under = np.lib.stride_tricks.sliding_window_view(v, span, 1).transpose(0, 1, 3, 2).reshape(len(x) * x.shape[1], span * DIMENSIONS)
        h = np.maximum((under @ self.conv).reshape(len(x), x.shape[1], -1).max(1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and mean probability over the windows of each text; ``und`` and 0 for texts without letters or an unfitted network.

        Windows of several texts are scored together, those of a long one in parts.
        """
        logs, total = np.zeros((2, len(texts), len(self.languages)))
        waiting: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def score() -> None:
            x, owner = np.concatenate(waiting), np.concatenate(owners)
            p = self.probabilities(x).astype(np.float64)
            filled = (x != 0).mean(1)[:, None]
            np.add.at(logs, owner, np.log(np.maximum(p, 1e-9)) * filled)
            np.add.at(total, owner, p * filled)
            waiting.clear(), owners.clear()

        lettered = [bool(t) and bool(self.languages) and any(map(str.isalpha, t)) for t in texts]
        for i in np.flatnonzero(lettered):
            x = windows(texts[i])
            for at in range(0, len(x), SCORED):
                waiting.append(x[at : at + SCORED])
                owners.append(np.full(len(waiting[-1]), i))
                if sum(map(len, waiting)) >= SCORED:
                    score()
        if waiting:
            score()
        best = logs.argmax(1) if self.languages else []
        return [(self.languages[best[i]], float(total[i, best[i]] / max(total[i].sum(), 1e-9))) if lettered[i] else (UNKNOWN, 0.0) for i in range(len(texts))]


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Network:
    """A network of labelled texts; without texts it predicts ``und`` for all."""
    languages = sorted(set(langs))
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    if not languages:
        return net
    xs, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        w = windows(t)
        if not any(map(str.isalpha, t)):
            continue
        pick = rng.choice(len(w), min(len(w), TRAINING_WINDOWS), replace=False)
        xs.append(w[pick])
        ys += [languages.index(lang)] * len(pick)
    if not xs:
        return Network([], seed)
    x, y = np.concatenate(xs), np.array(ys)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            pre, best, under = net.hidden(x[take])
            h = np.maximum(pre, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(take)), y[take]] -= 1
            p /= len(take)
            d_h = (p @ net.out.T) * (pre > 0)
            # only the place of the largest response of each filter gets a gradient
            rows = (np.arange(len(take))[:, None] * LENGTH + best).ravel()
            col = np.tile(np.arange(d_h.shape[1]), len(take))
            seen = under[rows]
            d_conv = (seen * d_h.ravel()[:, None]).reshape(len(take), d_h.shape[1], -1).sum(0).T * net.mask
            d_under = (net.conv.T[col] * d_h.ravel()[:, None]).reshape(-1, max(WIDTHS), DIMENSIONS)
            where = np.pad(x[take], ((0, 0), (0, max(WIDTHS) - 1)))
            byte = where[np.repeat(np.arange(len(take)), d_h.shape[1])[:, None], best.ravel()[:, None] + np.arange(max(WIDTHS))].ravel()
            d_emb = np.stack([np.bincount(byte, d_under[:, :, k].ravel(), 256) for k in range(DIMENSIONS)], 1)
            d_emb[0] = 0
            step += 1
            for q, g, (m, v) in zip(net.parameters(), (d_emb, d_conv, d_h.sum(0), h.T @ p, p.sum(0)), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` documents with a language outside the held-out ones, the first in the order of a hash of doc_id.

    Rows that repeat an id are cut at ``rows`` too.
    """
    usable = docs.withColumn("text", F.try_validate_utf8("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TRAINING_CHARS) & ~held_out(F.col("doc_id")))
    # ids are chosen before texts are read, so that no text is sorted
    chosen = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    found = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "lang").limit(rows).select("text", "lang")


def languages(docs: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row; ``und`` for null texts and texts without letters.

    Whole texts count, however long; equal texts score alike but for rounding. Repeated rows are each returned. Bad bytes
    of invalid UTF-8 count as replacement characters.
    """
    sample = training_rows(docs, rows).toPandas().sort_values(["text", "lang"])
    shared = docs.sparkSession.sparkContext.broadcast(fit(list(sample["text"]), list(sample["lang"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found = net.predict([*decoded(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

"""Training of the window network on Spark: examples are a table, epochs are passes over its partitions.

In each epoch examples are dealt anew over the partitions by a seeded hash, and every partition trains a copy of the
shared parameters on its own; the copies are averaged,
weighted by their examples, in groups of bounded size. One partition is plain mini-batch training. Nothing but
parameters and counters reaches the driver. Several seeds or configurations are independent runs of ``train``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kireme.functions.text import normalize
from kireme.operators.relational import vocabulary
from kireme.operators.scoring import NeuralScorer, units
from kireme.operators.workers import once
from kireme.plans.network import Adam, Batch, Config, Diffusion, Parameters, Sgd, backward, forward, project, quantize, signed_start
from kireme.sources.models import NeuralModel

log = logging.getLogger(__name__)
EXAMPLE = "status string, label int, slots array<array<int>>, features array<int>"
FAN = 32


def build_vocabulary(sentences: DataFrame, min_count: int = 2) -> list[int]:
    """Normalized code points seen often enough, ascending; as many as Unicode has at most."""
    return [r[0] for r in vocabulary(sentences.filter(F.is_valid_utf8("text")), min_count).orderBy("cp").select("cp").collect()]


def build_examples(sentences: DataFrame, vocab: list[int], dictionaries: list[list[str]], window: int) -> DataFrame:
    """Rows (status, label, slots, features) of annotated sentences (text, tags).

    Status ``example`` has one row per labelled gap between clusters. ``unknown`` counts gaps without a label,
    ``conflict`` sentences with a word boundary inside a cluster (they give nothing), ``invalid`` sentences of invalid
    UTF-8. Gaps inside clusters are no examples.
    """
    width = 12 * max(1, len(dictionaries))
    shape = NeuralModel(window, vocab, np.zeros((len(vocab) + 2, 1), np.int16), np.zeros((1, 2 * window, 1), np.int16), np.zeros(1), np.zeros(1, np.int16), 0.0, 1.0, 1.0, 1.0, 1.0, np.zeros((1, width), np.int16) if dictionaries else None, 1.0, dictionaries)
    shared = sentences.sparkSession.sparkContext.broadcast(shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, w = once(shared, _exact_scorer), shared.value.window
        for batch in batches:
            u = units(batch["text"].tolist(), True)
            tags = [np.array([np.nan if t is None else t for t in row], float) for row in batch["tags"]]
            tag_at = np.concatenate([[0], np.cumsum([len(t) for t in tags])]).astype(np.int64)
            flat = np.concatenate([*tags, np.zeros(0)])
            gaps = u.boundaries()
            text = np.repeat(np.arange(len(tags)), np.diff(u.first))[gaps]
            # a gap between clusters has the tag of the last character before it
            labels = flat[tag_at[text] + u.unit_at[gaps + 1] - 1 - u.unit_at[u.first[text]]]
            bound = np.add.reduceat(np.append(flat == 1, False), tag_at[:-1]) * (np.diff(tag_at) > 0) if len(tags) else np.zeros(0)
            conflict = bound > np.bincount(text[labels == 1], minlength=len(tags))
            rows = scorer.row_of[u.cps]
            cluster = [rows[a:b].tolist() for a, b in zip(u.unit_at[:-1], u.unit_at[1:], strict=True)]
            where, feature = scorer.features(u)
            low, high = np.searchsorted(where, gaps), np.searchsorted(where, gaps, "right")
            out = [("conflict", None, None, None)] * int(conflict.sum())
            for k in np.flatnonzero(~conflict[text]).tolist():
                if np.isnan(labels[k]):
                    out.append(("unknown", None, None, None))
                    continue
                b, first, end = int(gaps[k]), int(u.first[text[k]]), int(u.first[text[k] + 1])
                slots = [cluster[i] if first <= i < end else [0] for i in range(b - w + 1, b + w + 1)]
                out.append(("example", int(labels[k]), slots, feature[low[k] : high[k]].tolist()))
            yield pd.DataFrame(out, columns=["status", "label", "slots", "features"]).astype({"label": "Int32"})

    valid = sentences.filter(F.is_valid_utf8("text")).select("text", "tags").mapInPandas(run, EXAMPLE)
    bad = sentences.filter(~F.is_valid_utf8("text")).select(F.lit("invalid").alias("status"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("array<array<int>>").alias("slots"), F.lit(None).cast("array<int>").alias("features"))
    return valid.unionByName(bad)


def _exact_scorer(m: NeuralModel) -> NeuralScorer:
    return NeuralScorer(m, "int32")


def example_statistics(examples: DataFrame) -> DataFrame:
    return examples.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Options:
    epochs: int = 100
    passes: int = 1
    """passes over a partition in each epoch"""
    batch: int = 256
    patience: int = 15
    seed: int = 42
    optimizer: str = "adam"
    lr: float = 1e-3
    decay: float = 0.0
    diffusion: Diffusion | None = None
    """error diffusion instead of backpropagation"""


@dataclass
class Result:
    params: Parameters
    metrics: dict | None
    losses: list[float]
    epochs: int


def _batches(frames: list[pd.DataFrame], n_features: int, size: int, rng: np.random.Generator) -> Iterator[Batch]:
    all_ = pd.concat(frames, ignore_index=True)
    order = rng.permutation(len(all_))
    slots, feats, labels = all_["slots"].tolist(), all_["features"].tolist(), all_["label"].tolist()
    for at in range(0, len(order), size):
        take = order[at : at + size]
        yield Batch.of([slots[i] for i in take], [list(feats[i]) for i in take], [labels[i] for i in take], n_features)


#: Examples that a task shuffles and trains on at once.
SHUFFLED = 200_000


def dealt(examples: DataFrame, parts: int, seed: int, epoch: int) -> DataFrame:
    """The examples dealt anew over ``parts`` partitions, each once; which one they go to changes with the epoch.

    Examples have an ``id`` of their own, so equal ones (however many there are) are spread too, and a task that is run
    again gets the same ones.
    """
    return examples.repartition(parts, F.xxhash64("id", F.lit(seed), F.lit(epoch))) if parts > 1 else examples


def _epoch(examples: DataFrame, c: Config, o: Options, params: Parameters, diffusion: Diffusion | None, epoch: int) -> DataFrame:
    shared = examples.sparkSession.sparkContext.broadcast((params, diffusion))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        p, d = shared.value[0].copy(), shared.value[1]
        rng = np.random.default_rng((o.seed, epoch, part))
        opt = Adam(o.lr, decay=o.decay) if o.optimizer == "adam" else Sgd(o.lr)
        total = seen = 0.0

        def learn(frames: list[pd.DataFrame]) -> None:
            nonlocal total, seen
            for k in range(o.passes):
                for b in _batches(frames, c.features, o.batch, rng):
                    before = p.w2.copy()
                    g, rows, loss = d.update(p, b) if d else backward(p, b)
                    opt.step(p, g, rows)
                    if d:
                        project(p)
                        d.track(p, before)
                    if k == 0:
                        total, seen = total + loss * len(b.targets), seen + len(b.targets)

        waiting: list[pd.DataFrame] = []
        for frame in batches:
            waiting.append(frame)
            if sum(map(len, waiting)) >= SHUFFLED:
                learn(waiting)
                waiting = []
        if any(map(len, waiting)):
            learn(waiting)
        if seen:
            feedback = d.weights(c.hidden).astype(np.float32).tobytes() if d else b""
            yield pd.DataFrame({"slot": [part], "weight": [seen], "loss": [total], "params": [p.pack() + feedback]})

    return examples.select("label", "slots", "features").mapInPandas(run, "slot long, weight double, loss double, params binary")


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    w = group["weight"].to_numpy()
    mean = sum(np.frombuffer(raw, np.float32) * (x / w.sum()) for x, raw in zip(w, group["params"], strict=True))
    return pd.DataFrame({"slot": [int(group["slot"].iloc[0]) // FAN], "weight": [w.sum()], "loss": [group["loss"].sum()], "params": [mean.astype(np.float32).tobytes()]})


def train(examples: DataFrame, dev: DataFrame | None, c: Config, o: Options, start: Parameters | None = None, report: Callable[[str], None] = log.info) -> Result:
    """Best parameters by F1 on ``dev`` (the first of equal ones), or the last ones without it.

    ``examples`` should be a stored table of ``build_examples`` rows; its partitions are the parallel trainers.
    """
    # ids by partition and place: the stored table gives the same ones each time it is read
    examples = examples.filter("status = 'example'").withColumn("id", F.monotonically_increasing_id())
    params = start or (signed_start(c, o.seed) if o.diffusion else Parameters.init(c, o.seed))
    diffusion, best, best_params, losses, waited, epoch = o.diffusion, None, params, [], 0, 0
    parts = (examples.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0) + 1
    levels = max(1, int(np.ceil(np.log(parts) / np.log(FAN) - 1e-9)))
    for epoch in range(1, o.epochs + 1):  # noqa: B007
        copies = _epoch(dealt(examples, parts, o.seed, epoch), c, o, params, diffusion, epoch)
        for _ in range(levels):
            copies = copies.groupBy(F.floor(F.col("slot") / FAN).alias("g")).applyInPandas(_merge, "slot long, weight double, loss double, params binary")
        rows = copies.collect()
        # a plan that is dealt anew may have more partitions than were counted; what is over is as few rows
        if len(rows) > 1:
            rows = [Row(**_merge(pd.DataFrame([r.asDict() for r in rows])).iloc[0].to_dict())]
        if not rows:
            break
        row = rows[0]
        raw = bytes(row["params"])
        size = len(params.pack())
        params = params.unpack(raw[:size])
        if diffusion:
            diffusion = Diffusion(diffusion.embedding, diffusion.diffusion, diffusion.learn, diffusion.decay, np.frombuffer(raw[size:], np.float32).copy(), diffusion.initial)
        losses.append(row["loss"] / row["weight"])
        report(f"epoch {epoch}: loss {losses[-1]:.6f}")
        if dev is None:
            best_params = params
            continue
        metrics = evaluate(dev, params, c)
        report(f"epoch {epoch}: dev F1 {metrics['f1']:.4f}")
        if best is None or metrics["f1"] > best["f1"]:
            best, best_params, waited = metrics, params, 0
        else:
            waited += 1
            if waited >= o.patience:
                break
    return Result(best_params, best, losses, epoch)


def decisions(examples: DataFrame, params: Parameters, c: Config) -> DataFrame:
    """label, y (logit) and the largest absolute activation of every example."""
    shared = examples.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                _, a, y, _ = forward(shared.value, Batch.of(f["slots"].tolist(), [list(x) for x in f["features"]], f["label"].tolist(), c.features))
                yield pd.DataFrame({"label": f["label"].astype(int), "y": y.astype(float), "top": np.abs(a).max(1).astype(float)})

    return examples.filter("status = 'example'").select("label", "slots", "features").mapInPandas(run, "label int, y double, top double")


def evaluate(examples: DataFrame, params: Parameters, c: Config) -> dict:
    from kireme.operators.relational import confusion_metrics

    return confusion_metrics(decisions(examples, params, c).withColumn("cut", F.col("y") > 0)).first().asDict()


def activations(examples: DataFrame, params: Parameters, c: Config) -> DataFrame:
    """``bits`` of the absolute hidden activations (before ReLU) of all examples and ``n``, how often each occurs in a batch.

    The bits of non-negative 32-bit floats are ordered as their values are.
    """
    shared = examples.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                a = forward(shared.value, Batch.of(f["slots"].tolist(), [list(x) for x in f["features"]], f["label"].tolist(), c.features))[1]
                bits, n = np.unique(np.abs(a).astype(np.float32).ravel().view(np.uint32), return_counts=True)
                yield pd.DataFrame({"bits": bits.astype(np.int64), "n": n})

    return examples.filter("status = 'example'").select("label", "slots", "features").mapInPandas(run, "bits long, n long")


def lower_rank(counted: DataFrame, part: float = 0.9999) -> int | None:
    """The value at rank floor(part * (all - 1)), from 0, of ``bits`` that occur ``n`` times; None without any.

    Exact over all rows: 16 high bits are counted first, then the low bits of those that share the high ones of the
    answer, so that at most 65,536 counts come to the driver at a time.
    """
    high = sorted(tuple(r) for r in counted.groupBy(F.shiftright("bits", 16).alias("h")).agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in high)
    if not total:
        return None
    rank = int(part * (total - 1))
    for h, n in high:
        if rank < n:
            break
        rank -= n
    for low, n in sorted(tuple(r) for r in counted.filter(F.shiftright("bits", 16) == h).groupBy(F.col("bits").bitwiseAND(F.lit(0xFFFF)).alias("l")).agg(F.sum("n").alias("n")).collect()):
        if rank < n:
            return h << 16 | low
        rank -= n
    raise AssertionError("counts changed between two reads")


def export(examples: DataFrame, params: Parameters, c: Config, vocab: list[int], dictionaries: list[list[str]] | None = None, backend: str = "mlp") -> NeuralModel:
    """The 16-bit model, calibrated on the activations of all examples."""
    bits = lower_rank(activations(examples, params, c))
    top = np.zeros(0) if bits is None else np.array([bits], np.uint32).view(np.float32)
    return quantize(params, c, top, vocab, dictionaries, backend)


def sign_flips(texts: DataFrame, m: NeuralModel, text: str = "text") -> DataFrame:
    """Gaps whose 16-bit decision differs from the exact one: gaps, flips."""
    from kireme.plans.segmenter import Segmenter

    spark = texts.sparkSession
    small, exact = Segmenter(spark, m, "int16"), Segmenter(spark, m, "int32")
    both = texts.select(small.boundary_scores(F.col(text)).alias("a"), exact.boundary_scores(F.col(text)).alias("b"))
    flips = F.size(F.filter(F.zip_with("a", "b", lambda x, y: (x > 0) != (y > 0)), lambda z: z))
    return both.agg(F.sum(F.size("a")).alias("gaps"), F.sum(flips).alias("flips"))


def word_lists(words: DataFrame) -> list[str]:
    """A dictionary's normalized words, sorted. Dictionaries are part of a model and as small."""
    return [r[0] for r in words.select(normalize(F.col("word")).alias("word")).filter("word <> ''").distinct().orderBy("word").collect()]

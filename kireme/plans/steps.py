"""Training steps of the window network as tables: forward and backward passes, optimizers and error diffusion.

Parameters are rows (model, name, at, vec): an embedding row, the weights of a hidden unit in a slot (``at`` is slot x
hidden + unit), a feature's column, and the vectors ``b1``, ``w2``, ``b2`` and ``feedback``. ``model`` tells apart models that
learn side by side. Examples are rows (model, label, slots, features); with a column ``times`` a row stands for so many equal
examples, and ``merged`` makes such rows. A step joins each example with its model's
packed parameters (as large as the model, so broadcast), computes the example's part of each gradient in its own row,
and sums these parts by (model, name, at), partly before the one shuffle. These forms explain a result and check it
in SQL; the numpy form of the same arithmetic (``plans.network``) trains whole epochs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kireme.functions.arrays import let
from kireme.functions.numeric import bce
from kireme.plans.network import Parameters, polarity

NAMES = ("emb", "w1", "wdict", "b1", "w2", "b2", "feedback")
TABLE = "model string, name string, at int, vec array<double>"
KEYS = ("model", "name", "at")


@dataclass
class Shape:
    window: int
    dim: int
    hidden: int

    @property
    def slots(self) -> int:
        return 2 * self.window


def parameter_table(spark: SparkSession, p: Parameters, model: str = "", feedback: np.ndarray | None = None) -> DataFrame:
    """The rows of trained or fresh parameters."""
    h = len(p.b1)
    slots = p.w1.reshape(h, -1, p.emb.shape[1]).transpose(1, 0, 2).reshape(-1, p.emb.shape[1])
    parts = {"emb": p.emb, "w1": slots, "wdict": p.wdict.T, "b1": p.b1[None], "w2": p.w2[None], "b2": p.b2[None]}
    if feedback is not None:
        parts["feedback"] = feedback[None]
    return spark.createDataFrame([(model, n, i, [float(x) for x in v]) for n, rows in parts.items() for i, v in enumerate(rows)], TABLE)


def _times(examples: DataFrame) -> Column:
    return F.col("times").cast("double") if "times" in examples.columns else F.lit(1.0)


def merged(examples: DataFrame) -> DataFrame:
    """Equal examples as one row with their number, dealt to all cores: a pass costs much more than an example's bytes tell."""
    keys = ["model", "label", "slots", "features"]
    n = F.sum("times") if "times" in examples.columns else F.count(F.lit(1))
    found = examples.groupBy(*keys).agg(n.alias("times"))
    return found.repartition(examples.sparkSession.sparkContext.defaultParallelism, *keys)


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _range(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def packed(params: DataFrame) -> DataFrame:
    """One row for each model: its parameters as arrays by ``at``."""
    rows = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("at", "vec")))), lambda x: x["vec"])
    return params.groupBy("model").agg(*[rows(n).alias(n) for n in NAMES])


def _forward(s: Shape) -> Column:
    """x (a mean vector for each slot), a (activations before ReLU) and y (logit) of an example beside its packed parameters."""
    c = F.col
    mean = lambda rows: F.transform(_range(s.dim), lambda d: F.aggregate(rows, F.lit(0.0), lambda t, r: t + F.get(F.get(c("emb"), r), d)) / F.size(rows))
    unit = lambda x, h: F.get(F.get(c("b1"), F.lit(0)), h) + F.aggregate(_range(s.slots), F.lit(0.0), lambda t, k: t + _dot(F.get(x, k), F.get(c("w1"), k * s.hidden + h))) + F.aggregate(c("features"), F.lit(0.0), lambda t, f: t + F.get(F.get(c("wdict"), f), h))
    logit = lambda a: _dot(F.transform(a, lambda v: F.greatest(v, F.lit(0.0))), F.get(c("w2"), F.lit(0))) + F.get(F.get(c("b2"), F.lit(0)), F.lit(0))
    of = lambda x: let(F.transform(_range(s.hidden), lambda h: unit(x, h)), lambda a: F.struct(x.alias("x"), a.alias("a"), logit(a).alias("y")))
    return let(F.transform("slots", mean), of)


def forward(examples: DataFrame, params: DataFrame, shape: Shape) -> DataFrame:
    """The examples with x, a and y. ``slots`` are lists of embedding rows, ``features`` the active dictionary features."""
    both = examples.join(F.broadcast(packed(params)), "model")
    # a generator, so that the pass is computed once however often its parts are used
    return both.select(*examples.columns, *NAMES, F.inline(F.array(_forward(shape)))).drop(*(n for n in NAMES if n not in ("w1", "w2", "feedback")))


def _signs(n: int) -> Column:
    return F.array(*[F.lit(float(x)) for x in polarity(n)])


def gradients(examples: DataFrame, params: DataFrame, shape: Shape, rule: str = "backpropagation", diffusion: float = 1.0) -> DataFrame:
    """Rows (model, name, at, vec) of the mean gradient of each model's examples, and a row ``loss`` with their mean loss.

    Rules: ``backpropagation`` carries a unit's error back by its output weight; ``hybrid`` and ``pure`` are error
    diffusion and give each unit the output error times its row of ``feedback`` (a fixed sign, or tracked) and
    ``diffusion``. Embeddings learn through the first layer, but with ``pure`` every slot gets the output error with the sign
    of each dimension. Rows without an example's part are left out. A label is 0 or 1.
    """
    s, c = shape, F.col
    passed = forward(examples, params, s)
    error = 1.0 / (1.0 + F.exp(-c("y"))) - c("label")
    back = F.get(c("w2" if rule == "backpropagation" else "feedback"), F.lit(0))
    times = _times(examples)
    rows = passed.withColumn("_e", error * times)
    rows = rows.withColumn("_da", F.zip_with(back, c("a"), lambda w, a: F.when(a > 0, c("_e") * w * (1.0 if rule == "backpropagation" else diffusion)).otherwise(0.0)))
    part = lambda name, at, vec: F.struct(F.lit(name).alias("name"), at.cast("int").alias("at"), vec.alias("vec"))
    zero = F.lit(0)
    if rule == "pure":
        d_x = lambda k: F.transform(_signs(s.dim), lambda p: c("_e") * p * diffusion)
    else:
        d_x = lambda k: F.transform(_range(s.dim), lambda d: F.aggregate(_range(s.hidden), F.lit(0.0), lambda t, h: t + F.get(c("_da"), h) * F.get(F.get(c("w1"), k * s.hidden + h), d)))
    live = F.filter(_range(s.hidden), lambda h: F.get(c("_da"), h) != 0)
    slot = lambda k: F.transform(live, lambda h: part("w1", k * s.hidden + h, F.transform(F.get(c("x"), k), lambda v: v * F.get(c("_da"), h))))
    share = lambda k: let(d_x(k), lambda v: F.transform(F.get(c("slots"), k), lambda r: part("emb", r, F.transform(v, lambda q: q / F.size(F.get(c("slots"), k))))))
    parts = F.concat(
        F.flatten(F.transform(_range(s.slots), slot)), F.flatten(F.transform(_range(s.slots), share)), F.transform("features", lambda f: part("wdict", f, c("_da"))),
        F.array(part("b1", zero, c("_da")), part("w2", zero, F.transform("a", lambda a: F.greatest(a, F.lit(0.0)) * c("_e"))), part("b2", zero, F.array(c("_e"))), part("loss", zero, F.array(bce(c("y"), c("label").cast("double")) * times, times))),
    )
    wide = max(s.dim, s.hidden, 2)
    sums = rows.select("model", F.inline(parts)).groupBy(*KEYS).agg(*[F.sum(F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(wide)])
    vectors = sums.select(*KEYS, F.filter(F.array(*[f"_{i}" for i in range(wide)]), lambda v: v.isNotNull()).alias("vec"))
    n = vectors.filter("name = 'loss'").select("model", F.get("vec", F.lit(1)).alias("_n"))
    return vectors.join(F.broadcast(n), "model").select(*KEYS, F.transform(F.when(c("name") == "loss", F.slice("vec", 1, 1)).otherwise(c("vec")), lambda v: v / c("_n")).alias("vec"))


def sgd_step(params: DataFrame, grads: DataFrame, lr: float = 5.0) -> DataFrame:
    """Parameters moved against their gradient; rows without one stay."""
    both = params.join(grads.select(*KEYS, F.col("vec").alias("_g")), [*KEYS], "left")
    return both.select(*KEYS, F.when(F.col("_g").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_g", lambda p, g: p - lr * g)).alias("vec"))


def adam_start(params: DataFrame) -> DataFrame:
    """Moments of parameters before the first step."""
    zeros = F.transform("vec", lambda v: v * 0.0)
    return params.select(*KEYS, zeros.alias("m"), zeros.alias("v"), F.lit(0).alias("t"))


def adam_step(params: DataFrame, moments: DataFrame, grads: DataFrame, lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, decay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Parameters and moments after a step. An embedding row without a gradient keeps its moments and its own count of steps;
    other rows without one have gradient 0. ``decay`` shrinks w1, wdict and w2 beside the gradient; ``feedback`` does not move."""
    g = F.coalesce("_g", F.transform("vec", lambda v: v * 0.0))
    both = params.join(moments, [*KEYS]).join(grads.select(*KEYS, F.col("vec").alias("_g")), [*KEYS], "left")
    moves = (F.col("name") != "feedback") & ((F.col("name") != "emb") | F.col("_g").isNotNull())
    mixed = lambda old, new, b: F.zip_with(old, new, lambda x, y: x + (1 - b) * (y - x))
    made = both.select(
        *KEYS, "vec", moves.alias("_moves"), F.when(moves, mixed(F.col("m"), g, beta1)).otherwise(F.col("m")).alias("m"),
        F.when(moves, mixed(F.col("v"), F.transform(g, lambda x: x * x), beta2)).otherwise(F.col("v")).alias("v"), (F.col("t") + moves.cast("int")).alias("t"),
    )
    change = F.zip_with("m", "v", lambda m, v: lr * (m / (1 - F.pow(F.lit(beta1), F.col("t")))) / (F.sqrt(v / (1 - F.pow(F.lit(beta2), F.col("t")))) + eps))
    kept = F.when(F.col("name").isin("w1", "wdict", "w2"), 1 - lr * decay).otherwise(1.0)
    moved = F.zip_with("vec", change, lambda p, d: p * kept - d)
    return made.select(*KEYS, F.when(F.col("_moves"), moved).otherwise(F.col("vec")).alias("vec")), made.select(*KEYS, "m", "v", "t")


def _signed(vec: Column, hidden: int, body) -> Column:
    return F.zip_with(vec, _signs(hidden), body)


def signed_start(params: DataFrame, hidden: int, initial: float = 1.0) -> DataFrame:
    """Output weights take the fixed sign of their unit, and ``feedback`` starts as that sign times ``initial``."""
    own = params.filter("name <> 'feedback'").withColumn("vec", F.when(F.col("name") == "w2", _signed(F.transform("vec", F.abs), hidden, lambda v, p: v * p)).otherwise(F.col("vec")))
    return own.unionByName(own.filter("name = 'w2'").select("model", F.lit("feedback").alias("name"), "at", F.transform(_signs(hidden), lambda p: p * initial).alias("vec")))


def project(params: DataFrame, hidden: int) -> DataFrame:
    """Output weights on the wrong side of their unit's sign are pinned to 0."""
    return params.withColumn("vec", F.when(F.col("name") == "w2", _signed(F.col("vec"), hidden, lambda v, p: F.when(v * p < 0, 0.0).otherwise(v))).otherwise(F.col("vec")))


def track_feedback(before: DataFrame, after: DataFrame, decay: float = 0.01) -> DataFrame:
    """``after`` with feedback that follows the output weights: it adds their change since ``before``, and both shrink."""
    old = before.filter("name = 'w2'").select("model", F.col("vec").alias("_old"))
    new = after.filter("name = 'w2'").select("model", F.col("vec").alias("_new"))
    # one row for each model
    change = F.broadcast(old.join(new, "model").select("model", F.zip_with("_new", "_old", lambda a, b: a - b).alias("_change")))
    followed = F.when(F.col("name") == "feedback", F.zip_with("vec", "_change", lambda f, d: (f + d) * (1 - decay))).when(F.col("name") == "w2", F.transform("vec", lambda v: v * (1 - decay))).otherwise(F.col("vec"))
    return after.join(change, "model").select(*KEYS, followed.alias("vec"))


def diffusion_state(params: DataFrame) -> DataFrame:
    """For each model: ``pinned`` output weights at 0, and ``gap``, how far feedback is from them, relative to them."""
    both = packed(params).select("model", F.get("w2", F.lit(0)).alias("w"), F.get("feedback", F.lit(0)).alias("f"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return both.select("model", F.size(F.filter("w", lambda x: x == 0)).cast("long").alias("pinned"), (norm(F.zip_with("f", "w", lambda a, b: a - b)) / F.greatest(norm(F.col("w")), F.lit(1e-12))).alias("gap"))


def diffusion_step(examples: DataFrame, params: DataFrame, shape: Shape, rule: str = "hybrid", lr: float = 5.0, diffusion: float = 1.0, decay: float | None = None) -> DataFrame:
    """Parameters after one step of error diffusion: gradient, step, projection and, with ``decay``, tracked feedback."""
    moved = project(sgd_step(params, gradients(examples, params, shape, rule, diffusion), lr), shape.hidden)
    return moved if decay is None else track_feedback(params, moved, decay)

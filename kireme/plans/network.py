"""The trainable window network in numpy: batches, gradients, optimizers, error diffusion and quantization.

Training itself runs on Spark partitions (``plans.training``); these are the steps inside a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from kireme.functions.numeric import round_away
from kireme.sources.models import NeuralModel


@dataclass
class Config:
    window: int
    dim: int
    hidden: int
    vocab: int
    n_dicts: int = 0

    @property
    def features(self) -> int:
        return 12 * self.n_dicts


@dataclass
class Parameters:
    emb: np.ndarray
    w1: np.ndarray
    wdict: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    NAMES = ("emb", "w1", "wdict", "b1", "w2", "b2")

    @classmethod
    def init(cls, c: Config, seed: int) -> Parameters:
        rng, width = np.random.default_rng(seed), 2 * c.window * c.dim
        f = lambda sd, *shape: (rng.normal(0, sd, shape)).astype(np.float32)
        return cls(f(0.1, c.vocab, c.dim), f(np.sqrt(2 / (width + c.features)), c.hidden, width), f(np.sqrt(2 / (width + c.features)), c.hidden, c.features), np.zeros(c.hidden, np.float32), f(np.sqrt(1 / c.hidden), c.hidden), np.zeros(1, np.float32))

    def copy(self) -> Parameters:
        return Parameters(*(getattr(self, n).copy() for n in self.NAMES))

    def pack(self) -> bytes:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float32).tobytes()

    def unpack(self, raw: bytes) -> Parameters:
        """Parameters of this one's shapes from packed bytes."""
        flat, out, at = np.frombuffer(raw, np.float32), [], 0
        for n in self.NAMES:
            own = getattr(self, n)
            out.append(flat[at : at + own.size].reshape(own.shape).copy())
            at += own.size
        return Parameters(*out)


@dataclass
class Batch:
    """Slots of examples: ``rows`` lists the vocabulary rows of all slots, ``slot_at`` where each of the B x 2w slots starts."""

    rows: np.ndarray
    slot_at: np.ndarray
    features: np.ndarray
    targets: np.ndarray

    @classmethod
    def of(cls, slots: list[list[list[int]]], features: list[list[int]], labels: list[int], n_features: int) -> Batch:
        flat = [s for ex in slots for s in ex]
        at = np.concatenate([[0], np.cumsum([len(s) for s in flat])]).astype(np.int64)
        f = np.zeros((len(slots), n_features), np.float32)
        for i, on in enumerate(features):
            f[i, on] = 1
        return cls(np.array([r for s in flat for r in s], np.int64), at, f, np.array(labels, np.float32))

    def input(self, emb: np.ndarray) -> np.ndarray:
        """Mean vectors of the slots, joined for each example."""
        n = np.diff(self.slot_at)
        mean = np.add.reduceat(emb[self.rows], self.slot_at[:-1], 0) / n[:, None]
        return mean.reshape(len(self.targets), -1).astype(np.float32)


def forward(p: Parameters, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Input, hidden activations before ReLU, logits and mean loss."""
    x = b.input(p.emb)
    a = x @ p.w1.T + b.features @ p.wdict.T + p.b1
    y = np.maximum(a, 0) @ p.w2 + p.b2[0]
    loss = np.maximum(y, 0) - y * b.targets + np.log1p(np.exp(-np.abs(y)))
    return x, a, y, float(loss.mean()) if len(y) else 0.0


def _error(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    return ((1 / (1 + np.exp(-np.clip(y, -60, 60))) - t) / len(t)).astype(np.float32)


def _scatter(b: Batch, d_x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    n = np.diff(b.slot_at)
    share = d_x.reshape(len(n), -1) / n[:, None]
    out = np.zeros(shape, np.float32)
    np.add.at(out, b.rows, np.repeat(share, n, 0))
    return out


def _gradients(p: Parameters, b: Batch, x: np.ndarray, a: np.ndarray, delta: np.ndarray, back: np.ndarray, d_x: np.ndarray | None = None) -> tuple[Parameters, np.ndarray]:
    d_a = delta[:, None] * back[None] * (a > 0)
    d_x = d_a @ p.w1 if d_x is None else d_x
    g = Parameters(_scatter(b, d_x, p.emb.shape), d_a.T @ x, d_a.T @ b.features, d_a.sum(0), np.maximum(a, 0).T @ delta, np.array([delta.sum()], np.float32))
    return g, np.unique(b.rows)


def backward(p: Parameters, b: Batch) -> tuple[Parameters, np.ndarray, float]:
    """Gradients of the mean loss, the embedding rows touched, and the loss."""
    x, a, y, loss = forward(p, b)
    return *_gradients(p, b, x, a, _error(y, b.targets), p.w2), loss


@dataclass
class Sgd:
    lr: float = 5.0

    def step(self, p: Parameters, g: Parameters, rows: np.ndarray) -> None:
        for n in Parameters.NAMES[1:]:
            getattr(p, n)[...] -= self.lr * getattr(g, n)
        p.emb[rows] -= self.lr * g.emb[rows]


@dataclass
class Adam:
    """Embedding rows keep moments and step counts of their own and move only when a batch touches them."""

    lr: float = 1e-3
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.0
    t: int = 0
    moments: dict = field(default_factory=dict)

    def step(self, p: Parameters, g: Parameters, rows: np.ndarray) -> None:
        self.t += 1
        for n in Parameters.NAMES[1:]:
            m, v = self.moments.setdefault(n, (np.zeros_like(getattr(p, n)), np.zeros_like(getattr(p, n))))
            d = getattr(g, n)
            m += (1 - self.beta1) * (d - m)
            v += (1 - self.beta2) * (d * d - v)
            q = getattr(p, n)
            if self.decay and n in ("w1", "wdict", "w2"):
                q *= 1 - self.lr * self.decay
            q -= self.lr * (m / (1 - self.beta1**self.t)) / (np.sqrt(v / (1 - self.beta2**self.t)) + self.eps)
        m, v, t = self.moments.setdefault("emb", (np.zeros_like(p.emb), np.zeros_like(p.emb), np.zeros(len(p.emb))))
        d = g.emb[rows]
        t[rows] += 1
        m[rows] += (1 - self.beta1) * (d - m[rows])
        v[rows] += (1 - self.beta2) * (d * d - v[rows])
        steps = t[rows][:, None]
        p.emb[rows] -= self.lr * (m[rows] / (1 - self.beta1**steps)) / (np.sqrt(v[rows] / (1 - self.beta2**steps)) + self.eps)


def polarity(hidden: int) -> np.ndarray:
    """+1 for the first half of the hidden units, -1 for the rest."""
    return np.where(np.arange(hidden) < hidden // 2, 1, -1).astype(np.float32)


@dataclass
class Diffusion:
    """Error diffusion: hidden units learn from a fixed sign (or a tracked feedback weight) instead of the output weights.

    ``embedding``: ``hybrid`` carries the hidden errors back through the first layer, ``pure`` gives every slot the
    output error with the fixed sign of each dimension. ``learn`` moves the feedback along with the output weights (Kolen-Pollack).
    """

    embedding: str = "hybrid"
    diffusion: float = 1.0
    learn: bool = False
    decay: float = 0.01
    feedback: np.ndarray | None = None
    initial: float = 1.0

    def weights(self, hidden: int) -> np.ndarray:
        if self.feedback is None:
            self.feedback = polarity(hidden) * np.float32(self.initial)
        return self.feedback

    def update(self, p: Parameters, b: Batch) -> tuple[Parameters, np.ndarray, float]:
        x, a, y, loss = forward(p, b)
        delta = _error(y, b.targets)
        back = self.weights(len(p.w2)) * np.float32(self.diffusion)
        d_x = None
        if self.embedding == "pure":
            dim = p.emb.shape[1]
            d_x = delta[:, None] * np.tile(polarity(dim), x.shape[1] // dim)[None] * np.float32(self.diffusion)
        return *_gradients(p, b, x, a, delta, back, d_x), loss

    def track(self, p: Parameters, before: np.ndarray) -> None:
        if self.learn:
            self.feedback = (self.weights(len(p.w2)) + (p.w2 - before)) * np.float32(1 - self.decay)
            p.w2 *= np.float32(1 - self.decay)

    def gap(self, p: Parameters) -> float:
        """How far the feedback is from the output weights, relative to them."""
        return float(np.linalg.norm(self.weights(len(p.w2)) - p.w2) / max(np.linalg.norm(p.w2), 1e-12))


def signed_start(c: Config, seed: int) -> Parameters:
    p = Parameters.init(c, seed)
    p.w2 = np.abs(p.w2) * polarity(c.hidden)
    return p


def project(p: Parameters) -> int:
    """Pin output weights on the wrong side of their sign to 0; returns how many are 0."""
    p.w2[p.w2 * polarity(len(p.w2)) < 0] = 0
    return int((p.w2 == 0).sum())


def max_abs_scale(x: np.ndarray) -> float:
    top = float(np.abs(x).max(initial=0))
    return top / 32767 if top else 1.0


def quantize_tensor(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(round_away(x.astype(np.float64) / scale), -32767, 32767).astype(np.int16)


def calibrated_scale(activations: np.ndarray) -> float:
    """Accumulator unit: the 99.99th percentile (lower rank) of the absolute activations over 2**22; 1 if there is none."""
    v = np.abs(activations).ravel()
    top = float(np.partition(v, int(0.9999 * (len(v) - 1)))[int(0.9999 * (len(v) - 1))]) if v.size else 0.0
    return (top if np.isfinite(top) and top > 0 else 1.0) / (1 << 22)


def quantize(p: Parameters, c: Config, activations: np.ndarray, vocabulary: list[int], dictionaries: list[list[str]] | None = None, backend: str = "mlp") -> NeuralModel:
    """A 16-bit model of trained parameters, its accumulator unit calibrated on hidden activations before ReLU."""
    scales = {n: max_abs_scale(getattr(p, n)) for n in ("emb", "w1", "wdict", "w2")}
    q = {n: quantize_tensor(getattr(p, n), s) for n, s in scales.items()}
    return NeuralModel(
        c.window, vocabulary, q["emb"], q["w1"].reshape(c.hidden, 2 * c.window, c.dim), p.b1.astype(np.float64), q["w2"], float(p.b2[0]),
        scales["emb"], scales["w1"], scales["w2"], calibrated_scale(activations), q["wdict"] if c.n_dicts else None, scales["wdict"], dictionaries or [], backend,
    )


def with_dictionaries(c: Config, n: int) -> Config:
    return replace(c, n_dicts=n)

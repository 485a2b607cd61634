"""Model files: the binary linear format and the neural format, read into small driver-side values that are broadcast."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kireme.errors import IoError, MalformedModel, UnsupportedModelFormat

# Fixed value: first line of a linear model file.
LINEAR_HEADER = ("KyTea", "0.4.0", "B", "utf8")
#: First lines of neural model files by backend; ``register_signature`` adds those of other writers.
SIGNATURES: dict[str, list[str]] = {"mlp": ["KiremeMLP 1"], "ed": ["KiremeED 1"]}
UNICODE_VERSION = 0x1000


def register_signature(backend: str, line: str) -> None:
    """Accept files of a backend that begin with another line."""
    SIGNATURES.setdefault(backend, []).append(line)


class Reader:
    """A cursor over little-endian bytes. Counts are checked against what is left before anything is allocated."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left():
            raise MalformedModel("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.take(n * np.dtype(kind).itemsize), kind)

    def until(self, end: bytes) -> bytes:
        k = self.data.find(end, self.at)
        if k < 0:
            raise MalformedModel("an end mark is missing")
        out, self.at = self.data[self.at : k], k + len(end)
        return out


@dataclass
class LinearModel:
    """Boundary weights of character n-grams, type n-grams and dictionary words; patterns are normalized characters."""

    char_window: int
    type_window: int
    dict_n: int
    multiplier: float
    bias: int
    char_patterns: dict[str, np.ndarray] = field(default_factory=dict)
    type_patterns: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    """in_dict bits by word"""
    dict_vector: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    char_map: str = ""

    def check(self) -> LinearModel:
        for patterns, window in ((self.char_patterns, self.char_window), (self.type_patterns, self.type_window)):
            if any(len(v) != 2 * window for v in patterns.values()):
                raise MalformedModel("a pattern has not two weights for each character of the window")
        channels = max((b.bit_length() for b in self.words.values()), default=0)
        if channels * 3 * self.dict_n > len(self.dict_vector):
            raise MalformedModel("the dictionary weights are too few")
        return self


def _patterns(r: Reader, payload) -> list[tuple[tuple[int, ...], object]]:
    """(character ids, payload) of each entry of a stored automaton: its states in depth-first order from the root."""
    r.value("B")
    n = r.value("I")
    if n == 0:
        return []
    if n * 13 > r.left():
        raise MalformedModel("more states than bytes")
    gotos, outputs, genuine = [], [], []
    for _ in range(n):
        if r.value("I") >= n:
            raise MalformedModel("a failure link is out of range")
        edges = r.array(np.dtype([("c", "<u2"), ("to", "<u4")]), r.value("I"))
        if (edges["to"] >= n).any() or (np.diff(edges["c"].astype(np.int64)) <= 0).any():
            raise MalformedModel("transitions are out of range or not ascending")
        gotos.append(edges)
        outputs.append(r.array("<u4", r.value("I")))
        genuine.append(r.value("B"))
    entries = r.value("I")
    if entries * 4 > r.left() or any(o.size and o.max() >= entries for o in outputs):
        raise MalformedModel("an output is out of range")
    values = [payload(r) for _ in range(entries)]
    out, seen, todo = [], 0, [(0, ())]
    visited = bytearray(n)
    while todo:
        state, path = todo.pop()
        if visited[state]:
            raise MalformedModel("a state is reached twice")
        visited[state] = 1
        seen += 1
        if genuine[state] and outputs[state].size:
            out.append((path, values[outputs[state][0]]))
        todo += [(int(t), (*path, int(c))) for c, t in zip(gotos[state]["c"], gotos[state]["to"], strict=True)]
    if seen != n:
        raise MalformedModel("a state is out of reach")
    return out


def _weights(r: Reader) -> np.ndarray:
    return r.array("<i2", r.value("I"))


def _skip_string(r: Reader) -> None:
    r.take(2 * r.value("I"))


def _skip_lookup(r: Reader) -> None:
    if r.value("B"):
        for _ in range(3):
            _patterns(r, _weights)
        for _ in range(4):
            _weights(r)


def _skip_classifier(r: Reader) -> None:
    n = r.value("i")
    if n:
        r.take(1 + 4 * n + 1 + 8)
        _skip_lookup(r)


def _word(r: Reader, levels: int) -> int:
    _skip_string(r)
    for _ in range(levels):
        for _ in range(r.value("I")):
            _skip_string(r)
            r.take(1)
    bits = r.value("B")
    for _ in range(levels):
        _skip_classifier(r)
    return bits


def _subword(r: Reader, levels: int) -> None:
    _skip_string(r)
    for _ in range(levels):
        for _ in range(r.value("I")):
            _skip_string(r)
            r.take(8)


def _skip_readings(r: Reader) -> None:
    """The language model of one level's readings."""
    order = r.value("I")
    if order:
        r.take(4)
        for _ in range(r.value("I")):
            n = r.value("I")
            r.take(2 * n + 8 + (0 if n == order else 8))


def char_ids(char_map: str) -> dict[str, int]:
    """Ids from 1 in the order of first occurrence; repeats take none."""
    out: dict[str, int] = {}
    for c in char_map:
        out.setdefault(c, len(out) + 1)
    return out


def parse_linear(data: bytes) -> LinearModel:
    r = Reader(data)
    if tuple(r.until(b"\n").decode("latin-1").split(" ")) != LINEAR_HEADER:
        raise UnsupportedModelFormat("not a binary linear model of a supported version and encoding")
    r.take(2)
    levels, cw, _, tw, _, dn = r.value("I"), *r.take(5)
    r.take(1 + 8 + 1)
    char_map = r.until(b"\0").decode("utf-8")
    classes = r.value("i")
    if classes < 2:
        raise MalformedModel("no classifier")
    r.take(1 + 4 * classes + 1)
    multiplier = r.value("d")
    if not r.value("B"):
        raise MalformedModel("no feature lookup")
    by_id = ["", *char_ids(char_map)]

    def text(ids: tuple[int, ...]) -> str:
        if any(i >= len(by_id) or i == 0 for i in ids):
            raise MalformedModel("a pattern has an unknown character")
        return "".join(by_id[i] for i in ids)

    chars = {text(k): v for k, v in _patterns(r, _weights)}
    types = {text(k): v for k, v in _patterns(r, _weights)}
    _patterns(r, _weights)
    dict_vector, biases = _weights(r), _weights(r)
    _weights(r), _weights(r)
    for _ in range(levels):
        for _ in range(r.value("I")):
            _skip_string(r)
        _skip_classifier(r)
    words = {text(k): v for k, v in _patterns(r, lambda x: _word(x, levels))}
    _patterns(r, lambda x: _subword(x, levels))
    for _ in range(levels):
        _skip_readings(r)
    return LinearModel(cw, tw, dn, multiplier, int(biases[0]) if biases.size else 0, chars, types, words, dict_vector, char_map).check()


@dataclass
class NeuralModel:
    """Quantized tensors of the window network. Row 0 of the embedding is padding, row 1 unknown."""

    window: int
    vocabulary: list[int]
    emb: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    emb_scale: float
    w1_scale: float
    w2_scale: float
    acc_scale: float
    wdict: np.ndarray | None = None
    wdict_scale: float = 1.0
    dictionaries: list[list[str]] = field(default_factory=list)
    backend: str = "mlp"

    @property
    def hidden(self) -> int:
        return len(self.b1)


def parse_neural(data: bytes, backend: str | None = None, dictionaries: list[list[str]] | None = None) -> NeuralModel:
    """A neural model; word lists that the file holds in a foreign form must be passed as ``dictionaries``."""
    r = Reader(data)
    line = r.until(b"\n").decode("latin-1")
    kind = next((k for k, lines in SIGNATURES.items() if line in lines), None)
    if kind is None or (backend and kind != backend):
        raise UnsupportedModelFormat("the first line is not that of the backend")
    w, d, h, n_dicts, _ = r.value("B"), r.value("H"), r.value("H"), r.value("B"), r.value("H")
    if w < 1 or not 1 <= d <= 256 or h < 1:
        raise MalformedModel("a dimension is out of range")

    def scale() -> float:
        s = r.value("d")
        if not np.isfinite(s) or s <= 0:
            raise MalformedModel("a scale is not positive")
        return s

    emb_scale, w1_scale = scale(), scale()
    wdict_scale = scale() if n_dicts else 1.0
    w2_scale, acc_scale = scale(), scale()
    v = r.value("I")
    if v < 2:
        raise MalformedModel("the vocabulary has no row for unknown characters")
    cps = r.array("<u4", v - 2).astype(np.int64)
    if (np.diff(cps) <= 0).any() or (cps > 0x10FFFF).any():
        raise MalformedModel("the vocabulary is not ascending")
    emb = r.array("<i2", v * d).reshape(v, d)
    w1 = r.array("<i2", h * 2 * w * d).reshape(h, 2 * w, d)
    wdict = r.array("<i2", h * 12 * n_dicts).reshape(h, 12 * n_dicts) if n_dicts else None
    b1, w2, b2 = r.array("<f8", h), r.array("<i2", h), r.value("d")
    words: list[list[str]] = []
    if n_dicts:
        if line == SIGNATURES[kind][0]:
            words = [[] for _ in range(n_dicts)]
            for _ in range(r.value("I")):
                word, channels = r.take(r.value("I")).decode("utf-8"), r.take(r.value("B"))
                for c in channels:
                    if c >= n_dicts:
                        raise MalformedModel("a channel is out of range")
                    words[c].append(word)
        elif dictionaries is None:
            raise UnsupportedModelFormat("the file's compiled dictionaries can't be read; pass the word lists")
        else:
            words, r.at = dictionaries, len(data)
    if r.left():
        raise MalformedModel("bytes follow the model")
    return NeuralModel(w, cps.tolist(), emb, w1, b1, w2, b2, emb_scale, w1_scale, w2_scale, acc_scale, wdict, wdict_scale, words, kind)


def serialize_neural(m: NeuralModel) -> bytes:
    """The file of a neural model under our own first line; dictionaries follow as words with their channels."""
    n = len(m.dictionaries)
    h, slots, d = m.w1.shape
    out = [SIGNATURES[m.backend][0].encode() + b"\n", struct.pack("<BHHBH", m.window, d, h, n, UNICODE_VERSION)]
    out.append(struct.pack("<dd", m.emb_scale, m.w1_scale) + (struct.pack("<d", m.wdict_scale) if n else b"") + struct.pack("<dd", m.w2_scale, m.acc_scale))
    out += [struct.pack("<I", len(m.vocabulary) + 2), np.asarray(m.vocabulary, "<u4").tobytes(), m.emb.astype("<i2").tobytes(), m.w1.astype("<i2").tobytes()]
    if n:
        out.append(m.wdict.astype("<i2").tobytes())
    out += [m.b1.astype("<f8").tobytes(), m.w2.astype("<i2").tobytes(), struct.pack("<d", m.b2)]
    if n:
        channels: dict[str, list[int]] = {}
        for c, words in enumerate(m.dictionaries):
            for word in words:
                channels.setdefault(word, []).append(c)
        out.append(struct.pack("<I", len(channels)))
        for word in sorted(channels):
            raw = word.encode("utf-8")
            out.append(struct.pack("<I", len(raw)) + raw + struct.pack("<B", len(channels[word])) + bytes(channels[word]))
    return b"".join(out)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A model file from any store that Spark reads."""
    try:
        row = spark.read.format("binaryFile").load(path).select("content").first()
    except Exception as e:
        raise IoError(str(e).splitlines()[0]) from e
    if row is None:
        raise IoError(f"no file at {path}")
    return bytes(row[0])


def load_model(data: bytes, backend: str | None = None) -> LinearModel | NeuralModel:
    """A model of the named backend (linear, mlp, ed), or of the one that the first bytes tell; unknown ones are taken for linear."""
    first = data.split(b"\n", 1)[0].decode("latin-1")
    neural = any(first in lines for lines in SIGNATURES.values())
    if backend == "linear" or (backend is None and not neural):
        return parse_linear(data)
    return parse_neural(data, backend)


def tensor_table(spark: SparkSession, m: NeuralModel) -> DataFrame:
    """The tensors as rows (name, at, value), for reports and queries over a model."""
    parts = {"emb": m.emb, "w1": m.w1, "w2": m.w2, "b1": m.b1} | ({"wdict": m.wdict} if m.wdict is not None else {})
    rows = [(k, i, float(x)) for k, v in parts.items() for i, x in enumerate(np.asarray(v).ravel())]
    return spark.createDataFrame(rows, "name string, at long, value double")

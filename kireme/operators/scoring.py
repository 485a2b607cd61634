"""Arrow-batch scoring: the texts of a batch become one array of code points, scored at once and cut back by text.

Nothing is shuffled; models are broadcast and their tables built once in a worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from kireme.functions.graphemes import cluster_starts, simple
from kireme.functions.numeric import I32, requant, round_away
from kireme.functions.text import NORMALIZED, TYPE_RANGES
from kireme.operators.trie import GAP, Trie
from kireme.sources.models import LinearModel, NeuralModel

_NORM = np.arange(0x110000, dtype=np.uint32)
for _a, _b in NORMALIZED.items():
    _NORM[ord(_a)] = ord(_b)
_TYPE = np.full(0x110000, ord("O"), np.int64)
for _letter, _ranges in reversed(TYPE_RANGES.items()):
    for _lo, _hi in _ranges:
        _TYPE[_lo : _hi + 1] = ord(_letter)


@dataclass
class Units:
    """Units (code points or clusters) of the texts of a batch.

    ``first`` has the first unit of each text and the number of all; ``cps`` and ``unit_at`` are the normalized code
    points and the place in ``cps`` where each unit starts (and the end); ``bytes_at`` the byte offset of each unit in
    its own text, ``sizes`` the bytes of each text.
    """

    first: np.ndarray
    cps: np.ndarray
    unit_at: np.ndarray
    bytes_at: np.ndarray
    sizes: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bytes_at)

    def boundaries(self) -> np.ndarray:
        """Units after which a gap is scored: all but the last of each text."""
        last = np.zeros(self.n, bool)
        filled = self.first[1:] > self.first[:-1]
        last[self.first[1:][filled] - 1] = True
        return np.flatnonzero(~last)


def units(texts: list[str], clustered: bool) -> Units:
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = _NORM[raw]
    lengths = np.array([len(t) for t in texts], np.int64)
    text_at = np.concatenate([[0], np.cumsum(lengths)])
    width = 1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width)])
    if not clustered or simple()[cps].all():
        start, first = np.arange(len(cps)), text_at
    else:
        # clusters follow the normalized text; only texts that need the rules are split by them
        parts = []
        for a, b in zip(text_at[:-1], text_at[1:], strict=True):
            own = cps[a:b]
            parts.append(a + (np.arange(b - a) if simple()[own].all() else cluster_starts(own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))))
        start = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Units(first, cps, np.concatenate([start, [len(cps)]]), byte[start] - byte[text_at[owner]], byte[text_at[1:]] - byte[text_at[:-1]])


def _with_gaps(u: Units, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values with a gap after each text, and where each unit moved to."""
    owner = np.repeat(np.arange(len(u.sizes)), np.diff(u.first))
    place = np.arange(u.n) + owner
    out = np.full(u.n + len(u.sizes), GAP, np.int64)
    out[place] = values
    return out, place


class LinearScorer:
    """Scores of the linear model: n-gram weights around each match, dictionary weights by distinct feature, and the bias."""

    clustered = False

    def __init__(self, m: LinearModel):
        self.m = m
        self.tries = []
        for patterns, window in ((m.char_patterns, m.char_window), (m.type_patterns, m.type_window)):
            if patterns:
                self.tries.append((Trie(tuple(map(ord, p)) for p in patterns), np.stack(list(patterns.values())).astype(np.int64), window))
            else:
                self.tries.append(None)
        self.words = Trie(tuple(map(ord, w)) for w in m.words) if m.words else None
        self.bits = np.array(list(m.words.values()), np.int64)

    def scores(self, u: Units) -> np.ndarray:
        """One score per boundary of ``u.boundaries()``."""
        m = self.m
        chars, place = _with_gaps(u, u.cps.astype(np.int64))
        types, _ = _with_gaps(u, _TYPE[u.cps])
        total = np.full(len(chars), m.bias, np.int64)
        text_of = np.cumsum(chars == GAP) - (chars == GAP)
        for ids, made in zip((chars, types), self.tries, strict=True):
            if made is None:
                continue
            trie, weights, window = made
            for n, start, found in trie.matches(ids):
                end = start + n - 1
                for j in range(2 * window):
                    at = end - window + j
                    ok = (at >= 0) & (at < len(chars))
                    ok[ok] = text_of[at[ok]] == text_of[end[ok]]
                    total[at[ok]] += weights[found[ok], j]
        if self.words is not None:
            self._dictionary(chars, text_of, total)
        return total[place[u.boundaries()]]

    def _dictionary(self, chars: np.ndarray, text_of: np.ndarray, total: np.ndarray) -> None:
        m = self.m
        slots = []
        for n, start, found in self.words.matches(chars):
            label, bits = min(n, m.dict_n) - 1, self.bits[found]
            for c in range(int(bits.max()).bit_length()):
                on = start[(bits >> c) & 1 == 1]
                for pos, at in ((0, on - 1), *((1, on + k) for k in range(n - 1)), (2, on + n - 1)):
                    ok = at >= 0
                    at, base = at[ok], on[ok]
                    at = at[text_of[at] == text_of[base]]
                    slots.append(at * (3 * m.dict_n * 8) + (c * 3 * m.dict_n + label * 3 + pos))
        if slots:
            # a feature counts once at a boundary, however many words give it
            distinct = np.unique(np.concatenate(slots))
            np.add.at(total, distinct // (3 * m.dict_n * 8), m.dict_vector[distinct % (3 * m.dict_n * 8)].astype(np.int64))

    def cuts(self, scores: np.ndarray) -> np.ndarray:
        return scores * self.m.multiplier > 0


class NeuralScorer:
    """Scores of the window network, exact (32 bits) or with saturating 16-bit sums in their fixed order."""

    clustered = True

    def __init__(self, m: NeuralModel, precision: str = "int16"):
        self.m, self.precision = m, precision
        self.row_of = np.ones(0x110000, np.int64)
        self.row_of[m.vocabulary] = np.arange(2, len(m.vocabulary) + 2)
        self.r = m.emb_scale * m.w1_scale / m.acc_scale
        self.w1 = m.w1.astype(np.int64)  # H x 2w x d
        self.b1_q = round_away(m.b1 / m.acc_scale).astype(np.int64)
        self.b2_q = int(round_away(np.float64(m.b2 / (m.w2_scale * m.acc_scale))))
        self.dict_q = round_away(m.wdict_scale / m.acc_scale * m.wdict.astype(np.float64)).astype(np.int64) if m.wdict is not None else None
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        channels: dict[str, list[int]] = {}
        for c, words in enumerate(m.dictionaries):
            for w in words:
                norm = "".join(NORMALIZED.get(x, x) for x in w)
                if norm and c not in channels.setdefault(norm, []):
                    channels[norm].append(c)
        self.channels_at = np.concatenate([[0], np.cumsum([len(c) for c in channels.values()])]).astype(np.int64)
        self.channels_of = np.array([c for cs in channels.values() for c in cs], np.int64)
        self.words = Trie(tuple(map(ord, w)) for w in channels) if channels else None

    def block(self, rows: tuple[int, ...], slot: int) -> np.ndarray:
        """Layer-one part (H) of a cluster in a slot, in accumulator units: the mean of its rows' vectors times the slot's weights."""
        total = self.m.emb[list(rows)].astype(np.int64).sum(0)
        return round_away((self.w1[:, slot] @ total) * (self.r / len(rows))).astype(np.int64)

    def _encode(self, u: Units) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """A number for each distinct cluster of a batch: its rows."""
        rows = self.row_of[u.cps]
        size = np.diff(u.unit_at)
        kinds: dict[tuple[int, ...], int] = {(0,): 0}
        if (size == 1).all():
            used, back = np.unique(rows, return_inverse=True)
            for v in used.tolist():
                kinds.setdefault((v,), len(kinds))
            return np.array([kinds[(v,)] for v in used.tolist()], np.int64)[back], list(kinds)
        out = np.array([kinds.setdefault(tuple(rows[a:b].tolist()), len(kinds)) for a, b in zip(u.unit_at[:-1], u.unit_at[1:], strict=True)], np.int64)
        return out, list(kinds)

    def features(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """(unit before the boundary, feature) of active dictionary features, distinct and ascending."""
        if self.words is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text_at = u.unit_at[u.first]
        owner = np.repeat(np.arange(len(u.sizes)), np.diff(text_at))
        ids = np.full(len(u.cps) + len(u.sizes), GAP, np.int64)
        at = np.arange(len(u.cps)) + owner
        ids[at] = u.cps
        unit_of = np.full(len(ids) + 1, -1, np.int64)
        unit_of[at[u.unit_at[:-1]]] = np.arange(u.n)
        # a match must end where a cluster starts, or at the text's end
        ends_at = unit_of.copy()
        ends_at[np.flatnonzero(ids == GAP)] = u.first[1:]
        width = 12 * max(1, len(self.m.dictionaries))
        out = [np.zeros(0, np.int64)]
        text_of = np.append(np.repeat(np.arange(len(u.sizes)), np.diff(u.first)), -1)
        for n, start, found in self.words.matches(ids):
            first, last = unit_of[start], ends_at[start + n]
            ok = (first >= 0) & (last >= 0)
            # a match counts in each of its word's channels
            times = self.channels_at[found[ok] + 1] - self.channels_at[found[ok]]
            s, e = np.repeat(first[ok], times), np.repeat(last[ok], times)
            place = np.arange(len(s)) - np.repeat(np.cumsum(times) - times, times)
            base = self.channels_of[np.repeat(self.channels_at[found[ok]], times) + place] * 12 + np.minimum(e - s, 4) - 1
            left = (s > 0) & (text_of[s - 1] == text_of[s])
            right = (e < u.n) & (text_of[e] == text_of[s])
            inner = e - s - 1
            gap = np.repeat(s, inner) + np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
            out += [(s - 1)[left] * width + base[left], gap * width + np.repeat(base, inner) + 4, (e - 1)[right] * width + base[right] + 8]
        distinct = np.unique(np.concatenate(out))
        return distinct // width, distinct % width

    def scores(self, u: Units) -> np.ndarray:
        w, h = self.m.window, self.m.hidden
        kind, kinds = self._encode(u)
        padded = np.concatenate([kind, np.zeros(1, np.int64)])
        text_of = np.repeat(np.arange(len(u.sizes)), np.diff(u.first))
        b = u.boundaries()
        where, feature = self.features(u)
        small = self.precision == "int16"
        tables = []
        for j in range(2 * w):
            for k in kinds:
                if (j, k) not in self.tables:
                    if len(self.tables) * h > 40_000_000:
                        self.tables.clear()
                    made = self.block(k, j)
                    self.tables[j, k] = requant(made) if small else made
            tables.append(np.stack([self.tables[j, k] for k in kinds]))
        out = np.zeros(len(b), np.int64)
        step = max(1, 2_000_000 // h)
        b1 = requant(self.b1_q).astype(np.int32) if small else self.b1_q
        for lo in range(0, len(b), step):
            part = b[lo : lo + step]
            acc = np.repeat(b1[None], len(part), 0)
            for j in range(2 * w):
                at = part - w + 1 + j
                inside = (at >= 0) & (at < u.n)
                at = np.where(inside, at, u.n)
                inside &= text_of[np.minimum(at, u.n - 1)] == text_of[part]
                acc += tables[j][padded[np.where(inside, at, u.n)]]
                if small:
                    np.clip(acc, -32768, 32767, out=acc)
            if feature.size:
                lo_f, hi_f = np.searchsorted(where, part), np.searchsorted(where, part, "right")
                for k in range(int((hi_f - lo_f).max(initial=0))):
                    rows = np.flatnonzero(lo_f + k < hi_f)
                    block = self.dict_q.T[feature[lo_f[rows] + k]]
                    acc[rows] += requant(block) if small else block
                    if small:
                        acc[rows] = np.clip(acc[rows], -32768, 32767)
            y = np.maximum(acc, 0).astype(np.int64) @ self.m.w2.astype(np.int64)
            out[lo : lo + step] = y + ((self.b2_q + 256) >> 9 if small else self.b2_q)
        return np.clip(out, *I32)

    def cuts(self, scores: np.ndarray) -> np.ndarray:
        return scores > 0


def scorer_of(model: LinearModel | NeuralModel, precision: str = "int16"):
    return LinearScorer(model) if isinstance(model, LinearModel) else NeuralScorer(model, precision)


def segments(scorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: offsets of each text's words in the two arrays of byte starts and ends."""
    u = units(texts, scorer.clustered)
    b = u.boundaries()
    begins = np.zeros(u.n, bool)
    begins[u.first[:-1][u.first[1:] > u.first[:-1]]] = True
    begins[b[scorer.cuts(scorer.scores(u))] + 1] = True
    at = np.flatnonzero(begins)
    owner = np.repeat(np.arange(len(texts)), np.diff(u.first))[at]
    start = u.bytes_at[at]
    end = np.empty_like(start)
    if len(at):
        same = np.concatenate([owner[1:] == owner[:-1], [False]])
        end[:-1] = start[1:]
        end[~same] = u.sizes[owner[~same]]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), start, end

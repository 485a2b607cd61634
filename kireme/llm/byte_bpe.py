"""Byte-level BPE as a finite-state transducer, and decoding by a UTF-8 state machine.

Merges by rank split a piece of text so that any two neighbouring tokens are what merging the two of them alone gives
back, and no other split has that property (Berglund and van der Merwe, "Formalizing BPE tokenization"). So a
transducer can read a piece from left to right: it guesses where tokens end, walks a trie of tokens, and lets a token
follow another only if the two stand the test. Its subsets are made deterministic when a text first needs them: a
state holds the open guesses, each a trie node and the token before it. Just one token can end at a place, and the state says
which; tokens come out once the ways back from all open guesses have met. No guess is older than the longest token,
so the lookahead is bounded, a state is small, and a piece costs its length.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import decoded, raw
from kireme.operators.workers import once

#: Distinct pieces whose ids a worker remembers, and their longest.
REMEMBERED, PIECE_CHARS = 800_000, 40
#: States and tested pairs that a worker keeps; beyond them it starts anew, with the same results.
STATES, PAIRS = 300_000, 800_000
#: Bytes after which tokens of a longer piece are emitted.
EMITTED = 256
#: Bytes of text that leave a worker at once.
HELD_BYTES = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _State(dict):
    """A set of guesses; as a dict, the steps found so far: byte -> state. ``token`` is the one that ends where the state is."""

    __slots__ = ("guesses", "token", "transducer")

    def __missing__(self, byte: int) -> _State:
        found = self[byte] = self.transducer.step(self, byte)
        return found


LAST = 1 << 62


class Transducer:
    """Ids of pieces under ranks that have all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        if len(self.token) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be distinct and hold every byte")
        # a trie of tokens: node << 8 | byte -> node
        child: dict[int, int] = {}
        ends: dict[int, int] = {}
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for depth, b in enumerate(token, 1):
                node = child.setdefault(node << 8 | b, len(child) + 1)
                if node == len(self.depth):
                    self.depth.append(depth)
            ends[node] = rank
        self.child, self.ends = child, ends
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.inner = {key >> 8 for key in child}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.sides: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.pairs: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.states: dict[tuple[int, ...], _State] = {}
        self.start = self.state((0,))

    def state(self, guesses: tuple[int, ...]) -> _State:
        """The state of guesses: trie node << 32 | token before it + 1 (0 before the first), the one at the root last."""
        found = self.states.get(guesses)
        if found is None:
            found = self.states[guesses] = _State()
            found.guesses, found.token, found.transducer = guesses, guesses[-1] - 1, self
        return found

    def merged(self, piece: bytes, until: int = 1) -> list[int]:
        """Ids by the definition: the neighbours of the lowest rank are merged, the first of equal ones, until none can be (or ``until`` are left)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, LAST), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == LAST:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is the token; None for a byte, and for a token that no merges lead to."""
        if token not in self.halves:
            parts = self.merged(self.token[token], 2)
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def reached(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self.split(token) is not None

    def spines(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """What stands at the token's left and at its right end while it is merged, from a byte to the whole."""
        if token not in self.sides:
            halves = self.split(token)
            self.sides[token] = ((token,), (token,)) if halves is None else (self.spines(halves[0])[0] + (token,), self.spines(halves[1])[1] + (token,))
        return self.sides[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether merging both tokens' bytes gives them back: whether no merge reaches across while either side grows.

        Merges come by rank, so both sides grow in the order of ranks. A merge across comes first if its rank is lower
        than that of the left side's next merge, and not higher than that of the right side's, as it stands before that.
        """
        if before < 0:
            return self.reached(token)
        pair = before << 32 | token
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.reached(token) and self._apart(self.spines(before)[1], self.spines(token)[0])
        return known

    def _apart(self, left: tuple[int, ...], right: tuple[int, ...]) -> bool:
        token, ranks, i, j = self.token, self.ranks, 0, 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else LAST
            next_right = right[j + 1] if j + 1 < len(right) else LAST
            across = ranks.get(token[left[i]] + token[right[j]])
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left == next_right == LAST:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def step(self, state: _State, byte: int) -> _State:
        guesses, cut = [], -1
        child, ends, inner = self.child, self.ends, self.inner
        # the oldest guess comes first; one alone stands the test
        for guess in state.guesses:
            to = child.get(guess >> 32 << 8 | byte)
            if to is not None:
                before = guess & 0xFFFFFFFF
                if to in inner:
                    guesses.append(to << 32 | before)
                if cut < 0 and to in ends and self.follows(before - 1, ends[to]):
                    cut = ends[to]
        guesses.append(cut + 1)
        return self.state(tuple(guesses))

    def back(self, path: list[int], at: int, to: int = 0) -> list[int]:
        """The tokens from ``to`` to ``at``; ``path`` has the token that ends after each byte."""
        out = []
        while at > to:
            out.append(path[at - 1])
            at -= self.size[out[-1]]
        out.reverse()
        return out

    def settled(self, state: _State, path: list[int]) -> int:
        """Up to where all open guesses have the same tokens behind them."""
        open_at = {len(path) - self.depth[g >> 32] for g in state.guesses}
        while len(open_at) > 1:
            last = max(open_at)
            open_at.remove(last)
            open_at.add(last - self.size[path[last - 1]])
        return open_at.pop()

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token is that token, even where no merges lead to it."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.states) >= STATES:
            self.restart()
        state, path, out = self.start, [], []
        for lo in range(0, len(piece), EMITTED):
            path += [(state := state[b]).token for b in piece[lo : lo + EMITTED]]
            if lo + EMITTED < len(piece):
                at = self.settled(state, path)
                out += self.back(path, at)
                del path[:at]
        return out + self.back(path, len(path))


class _Pieces(dict):
    """Ids of pieces (little-endian, unsigned, 32 bits), found when they are first asked for."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


# first bytes of a character's UTF-8 form: how many follow, and where the next one lies
def _opened(byte: int) -> tuple[int, int, int]:
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return 0, 0, 0


class Decoder:
    """Text of a stream of ids, character by character: a token may end inside a character, the state is the bytes that wait.

    Bytes that can't go on to a character become one replacement character for each longest valid beginning.
    """

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.steps: dict[bytes, dict[int, tuple[bytes, str]]] = {}

    def feed(self, waiting: bytes, data: bytes) -> tuple[bytes, str]:
        """The bytes that wait after ``data``, and the characters that are complete."""
        out, held = [], b""
        need = low = high = 0
        for b in waiting + data:
            if held and low <= b <= high:
                held, need, low, high = held + bytes([b]), need - 1, 0x80, 0xBF
            else:
                if held:
                    out.append("�")
                need, low, high = _opened(b)
                held = bytes([b]) if need else b""
                if not need:
                    out.append(chr(b) if b < 0x80 else "�")
            if held and not need:
                out.append(held.decode())
                held = b""
        return held, "".join(out)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each id completes, and at the end what bytes are left."""
        waiting = b""
        for i in ids:
            # with nothing waiting almost every token has been met before
            steps = self.steps.setdefault(waiting, {})
            if i not in steps:
                steps[i] = self.feed(waiting, self.token[i])
            waiting, text = steps[i]
            yield text
        if waiting:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


class Encoder:
    def __init__(self, made: tuple[str, str]):
        path, pattern = made
        self.pieces = _Pieces(Transducer(read_ranks(path)))
        self.find = regex.compile(pattern).findall

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))


class BytesDecoder:
    def __init__(self, path: str):
        self.decoder = Decoder({rank: token for token, rank in read_ranks(path).items()})

    def __call__(self, ids: bytes) -> str:
        return self.decoder.decode(np.frombuffer(ids, "<u4").tolist())


class RoundTrip:
    """Ids of a text and what they decode to."""

    def __init__(self, made: tuple[str, str]):
        self.encode, self.decode = Encoder(made), BytesDecoder(made[0])

    def __call__(self, text: str) -> tuple[bytes, str]:
        ids = self.encode(text)
        return ids, self.decode(ids)


def _mapped(docs: DataFrame, make: Callable, made_of: object, source: str, text: bool, **targets: str) -> DataFrame:
    """All columns and the targets (name=type); ``text`` tells a text from bytes in ``source``, made by what each worker makes once."""
    docs = docs.drop(*(t for t in targets if t in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(made_of)
    at, names = docs.columns.index(source), [*docs.columns, *targets]
    kinds = [pa.binary() if kind == "binary" else pa.string() for kind in targets.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = once(shared, make)

        def part(batch: pa.RecordBatch, lo: int, out: list[tuple]) -> pa.RecordBatch:
            made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*batch.slice(lo, len(out)).columns, *made], names)

        for batch in batches:
            out, size, lo = [], 0, 0
            for v in decoded(batch.column(at)) if text else raw(batch.column(at)):
                x = (None,) * len(kinds) if v is None else convert(v)
                out.append(x if isinstance(x, tuple) else (x,))
                size += sum(len(y or b"") for y in out[-1])
                if size >= HELD_BYTES:
                    yield part(batch, lo, out)
                    lo += len(out)
                    out, size = [], 0
            if out:
                yield part(batch, lo, out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{t}` {kind}" for t, kind in targets.items())])
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each whole text as little-endian unsigned 32-bit integers; null for null, none for the empty text.

    ``path`` is a file of ranks (base64 token, rank), ``pattern`` parts a text into pieces that are encoded by
    themselves; no token is special. Rows are independent, so ties, repeated rows and other columns (one named ``ids`` is
    replaced) don't matter. Bad bytes of invalid UTF-8 count as replacement characters. Results are those of merging
    by rank; a worker remembers pieces and states up to fixed numbers.
    """
    return _mapped(docs, Encoder, (path, pattern), text, True, **{ids: "binary"})


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids (as ``encode`` writes them); null for null. Bytes that are no UTF-8 become replacement characters."""
    return _mapped(rows, BytesDecoder, path, ids, False, **{text: "string"})


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` as ``encode`` and ``decoded`` as ``decode`` would, in one pass of one worker."""
    return _mapped(docs, RoundTrip, (path, pattern), text, True, ids="binary", decoded="string")


def encoding_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns over ``documents`` (doc_id, text); null texts count as empty."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return round_trip(texts, path, pattern).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

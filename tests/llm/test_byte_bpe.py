import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kireme.llm import byte_bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODE, DECODE = byte_bpe.Encoder((PATH, P.PATTERN)), byte_bpe.BytesDecoder(PATH)
TEXTS = ["", " ", "Hello world", "a" * 5000, "ab" * 3000, "x \n\n  y\t", "日本語のテキストを書く", "é́👩‍👩‍👧 " * 50, "<|endoftext|> 12345 don't I'LL", "\x00\x1c\x85᠎", "�" * 9, " " * 3000, "=" * 700 + "-" * 801, "ǅ௵𝟘Ⅷ" * 40]


def ids(text):
    return list(struct.unpack(f"<{len(ENCODE(text)) // 4}I", ENCODE(text)))


@pytest.mark.parametrize("text", TEXTS)
def test_transducer_equals_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert DECODE(ENCODE(text)) == text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("etaoin shrdlu", max_size=60) | st.text("ab", max_size=200))
def test_any_text_equals_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_transducer_equals_merges_on_any_bytes(piece):
    t = ENCODE.pieces.transducer
    want = [RANKS[piece]] if piece in RANKS else t.merged(piece)
    assert t.encode(piece) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=2, max_size=12), st.data())
def test_small_vocabularies(letters, data):
    tokens = [bytes([b]) for b in range(256)]
    for _ in range(data.draw(st.integers(1, 8))):
        new = data.draw(st.sampled_from(tokens[97:100] + tokens[256:])) + data.draw(st.sampled_from(tokens[97:100] + tokens[256:]))
        if new not in tokens:
            tokens.append(new)
    t = byte_bpe.Transducer({x: i for i, x in enumerate(tokens)})
    piece = "".join(letters).encode()
    assert t.encode(piece) == ([tokens.index(piece)] if piece in tokens else t.merged(piece))


def test_pair_test_equals_merging_both():
    rng, t = random.Random(3), ENCODE.pieces.transducer
    tokens = [i for i in t.token if t.reached(i)]
    for _ in range(20_000):
        a, b = rng.choice(tokens[: rng.choice([300, 3000, 50_256])]), rng.choice(tokens[: rng.choice([300, 3000, 50_256])])
        assert t.follows(a, b) == (t.merged(t.token[a] + t.token[b]) == [a, b])


def test_states_and_lookahead_are_bounded(monkeypatch):
    t = byte_bpe.Transducer(RANKS)
    t.encode(("abcdefgh" * 2000).encode())
    n = len(t.states)
    t.encode(("abcdefgh" * 4000).encode())
    longest = max(map(len, RANKS))
    assert len(t.states) == n and all(len(s.guesses) <= longest + 1 for s in t.states.values())
    # what has not come out after many bytes is a few tokens
    state, path = t.start, []
    for b in ("internationalisation-" * 30).encode() + b"a" * 500:
        state = state[b]
        path.append(state.token)
        assert len(path) - t.settled(state, path) <= 2 * longest
    monkeypatch.setattr(byte_bpe, "STATES", 10)
    monkeypatch.setattr(byte_bpe, "PAIRS", 3)
    small = byte_bpe.Transducer(RANKS)
    for text in ("internationalisation", "überraschung", "zzzyyyxxx"):
        assert small.encode(text.encode()) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=4) | st.sampled_from(["é日👩".encode()[k : k + 2] for k in range(8)]), max_size=12))
def test_decoder_equals_replacement_rules(tokens):
    decoder = byte_bpe.Decoder(dict(enumerate(tokens)))
    pieces = list(decoder.stream(range(len(tokens))))
    assert "".join(pieces) == b"".join(tokens).decode("utf-8", "replace")


def test_ranks_without_all_bytes_are_refused():
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.Transducer({b"a": 0})


def row(doc_id, text):
    found = LIBRARY.encode_ordinary(text or "")
    return doc_id, len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(map(tuple, queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(row(r.doc_id, r.text) for r in docs)


def test_awkward_rows(spark, docs, awkward, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HELD_BYTES", 40)
    table = awkward.unionByName(docs(*[(100 + i, t) for i, t in enumerate(TEXTS)]))
    got = sorted(map(tuple, byte_bpe.encoding_digest(table, PATH, P.PATTERN).collect()), key=repr)
    assert got == sorted((row(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=repr)
    kept = byte_bpe.encode(table.withColumn("ids", table.doc_id), PATH, P.PATTERN)
    assert kept.columns == [*table.columns, "ids"] and kept.filter("text is null").first().ids is None
    assert {r.text or "" for r in kept.collect()} == {r.decoded or "" for r in byte_bpe.decode(kept, PATH).collect()}
    assert byte_bpe.encoding_digest(docs(), PATH, P.PATTERN).count() == 0
    bad = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text")
    assert tuple(byte_bpe.encoding_digest(bad, PATH, P.PATTERN).first()) == row(1, "a�b")

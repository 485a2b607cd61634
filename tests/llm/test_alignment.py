import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kireme.llm import alignment, queries
from kireme.llm.packing import byte_letters

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
A.encode_special_tokens = True
LETTER = {c: i for i, c in enumerate(byte_letters())}
SIDES = alignment.Sides(PATHS)
TEXTS = ["Hello  world", " ", "   ", "a b ", "\n\n x\ty", "日本語のテキスト", "x▁y", "<|endoftext|> <s> <0x41>", "՘⃁ ࢏!", "é́👩‍👩‍👧 1234", "\x00\x1c\x85", "aaaa" * 500, "don't 's", "� ok"]


def tokens_of(text):
    """[(id, start, end)] of both sides over the bytes of blank + text, from the whole text; None if a side changes bytes."""
    whole = f" {text}".encode()
    sides = []
    for ids, token in ((A.encode(f" {text}", add_special_tokens=False).ids, lambda i: bytes(LETTER[c] for c in A.id_to_token(i))), (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())):
        at, out, joined = 0, [], b""
        for i in ids:
            out.append((i, at, at + len(token(i))))
            at += len(token(i))
            joined += token(i)
        if joined != whole:
            return None
        sides.append(out)
    return sides


def brute(rows):
    """The contract, pair by pair."""
    holds, made = collections.Counter(), []
    for key, text in rows:
        sides = tokens_of(text) if text else None
        if sides is None:
            made.append((key, 0, 0, 0, [], ""))
            continue
        a, b = sides
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for c in cuts:
            groups.append(",".join(str(x[0]) for x in a if lo < x[2] <= c) + "|" + ",".join(str(y[0]) for y in b if lo < y[2] <= c))
            lo = c
        holds.update(set(links))
        made.append((key, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return [(k, na, nb, ng, len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), sha) for k, na, nb, ng, links, sha in made]


@pytest.mark.parametrize("text", TEXTS)
def test_chunks_give_the_ids_of_whole_texts(text):
    assert SIDES.chunked
    x, sides = SIDES.align([text]), tokens_of(text)
    assert (x.a.tolist(), x.b.tolist()) == (([], []) if sides is None else tuple([t[0] for t in s] for s in sides))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(" \n\tab.é日", max_size=30), min_size=1, max_size=4))
def test_any_texts_equal_brute_force(texts):
    x = SIDES.align(texts)
    want = brute([*enumerate(texts)])
    got = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in SIDES.group_texts(x)]
    assert [(a, b, g, s) for a, b, g, s in zip(x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), got, strict=True)] == [(r[1], r[2], r[3], r[7]) for r in want]
    assert np.bincount(x.link_text, minlength=len(texts)).tolist() == [r[4] for r in want]


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 70000, 2**32 - 1])
    assert alignment._numbers(alignment._planes(x)).tolist() == x.tolist()
    assert alignment._numbers(alignment._planes(x[:0])).tolist() == []


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 30_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = docs.filter("coalesce(length(text), 0) < 3000").select("doc_id", "text")
    got = sorted(map(tuple, alignment.alignment_digest(short.repartition(3), *PATHS).collect()))
    assert got == sorted(brute([tuple(r) for r in short.collect()]))
    whole = {r.doc_id: r for r in queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert len(whole) == docs.count()
    assert all((r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (g[1], g[2], g[3], g[4], g[7]) for g in got for r in [whole[g[0]]])


def test_awkward_rows(spark, docs, awkward, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 60)
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    table = awkward.filter("doc_id is null or doc_id <> 7").unionByName(docs(*[(100 + i, t) for i, t in enumerate(TEXTS)]))
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    got = sorted(map(tuple, alignment.alignment_digest(table, *PATHS).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert alignment.alignment_digest(docs(), *PATHS).count() == 0
    assert alignment.alignment_digest(docs((1, None), (2, "")), *PATHS).count() == 2
    bad = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text")
    assert tuple(alignment.alignment_digest(bad, *PATHS).first()) == (1, 0, 0, 0, 0, 0, 0, "")
    long = alignment.alignment_digest(docs((7, "w " * 60000)), *PATHS).first()
    assert (long.n_a, long.n_links, long.n_best) == (60001, 60001, 60001)


def test_align_and_counts(docs):
    table = docs((1, "Hello world"), (2, "world"), (3, None))
    x = {r.doc_id: r for r in alignment.align(table, *PATHS).collect()}
    want = dict((r[0], r) for r in brute([(1, "Hello world"), (2, "world"), (3, None)]))
    assert all((r.n_a, r.n_b, r.n_groups, len(r.links)) == want[i][1:5] for i, r in x.items()) and x[3].groups == ""
    counts = {(r.a, r.b): r.n for r in alignment.pair_counts(table, *PATHS).collect()}
    held = collections.Counter(p for r in x.values() for p in {(q.a, q.b) for q in r.links})
    assert counts == held


def test_what_repeats_is_aligned_once(monkeypatch):
    sides, seen, plain = alignment.Sides(PATHS), [], alignment.aligned
    monkeypatch.setattr(alignment, "aligned", lambda a, *rest: seen.append(len(a)) or plain(a, *rest))
    text = "The same words, in each of many texts.\nThe end "
    for _ in range(3):
        distinct, at, n = sides.units([text] * 100 + [None])
        assert n.tolist() == [10] * 100 + [0] and len(at) == 1000
        assert ";".join(sides.groups[k] for k in distinct[at][:10].tolist()) == sides.group_texts(plain(*_line(text)))[0]
    assert seen == [len(tokens_of(text)[0])]


def _line(text):
    """Tokens of one whole text, as ``aligned`` takes them."""
    return [np.array(x) for s in tokens_of(text) for x in ([t[0] for t in s], [len(s)], [t[2] - t[1] for t in s])]


def test_forgetting_keeps_what_is_used_and_results(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    sides = alignment.Sides(PATHS)
    for k in range(60):
        texts = [f"the word {k} {k * 7919} stays, x{k}y\n é{k} ", "the x▁y word", None, TEXTS[k % len(TEXTS)]]
        distinct, at, n = sides.units(texts)
        numbers = distinct[at]
        want = brute([*enumerate(texts)])
        ends = np.cumsum(n).tolist()
        for s, e, (_, n_a, n_b, n_groups, n_links, _, _, sha) in zip([0, *ends], ends, want):
            assert [x[numbers[s:e]].sum() for x in (sides.n_a, sides.n_b, sides.n_groups, sides.n_links)] == [n_a, n_b, n_groups, n_links]
            assert (hashlib.sha256(";".join(sides.groups[i] for i in numbers[s:e]).encode()).hexdigest() if s < e else "") == sha
        assert len(sides.number) < 20 + 20 and (k == 0 or {" the", " word"} <= set(sides.number))
    assert len(sides.groups) == len(sides.number) == len(sides.fits) == len(sides.used)


def test_pieces_end_before_a_blank_behind_any_character():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(every), 4096):
        text = "".join(f"{c} b" for c in every[lo : lo + 4096])
        starts = {s for _, (s, _) in A.pre_tokenizer.pre_tokenize_str(text)}
        units = SIDES.split(f" {text}")
        assert "".join(units)[1:] == text
        cuts = set((np.cumsum([*map(len, units)]) - 1).tolist()[:-1])
        assert cuts <= starts and len(cuts) >= sum(not c.isspace() and c != "᠎" for c in every[lo : lo + 4096])


def test_long_units_are_encoded_from_blank_to_blank(monkeypatch):
    sides, plain, longest = alignment.Sides(PATHS), SIDES.second.encode, []
    text = "one\n two\n\t  three\n" * 3
    monkeypatch.setattr(sides, "_second", lambda chunks, f=sides._second: longest.append(max(map(len, chunks))) or f(chunks))
    distinct, at, n = sides.units([text, text * 2000])
    assert n.tolist() == [1, 1] and longest == [len(" three\none\n") + 1]
    numbers = distinct[at]
    assert sides.n_b[numbers].tolist() == [len(plain(text)), len(plain(text * 2000))]
    assert sides.groups[numbers[0]] == sides.group_texts(alignment.aligned(*_line(text)))[0]

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kireme.llm import periodic, queries

SPACE = b" \t\n\r\x0b\x0c"


def words_of(text):
    out, word = [], b""
    for b in (text or "").encode():
        if b in SPACE:
            out += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    return out + ([word] if word else [])


def brute_runs(w, shortest=12):
    """Every stretch by its definition: the longest stretch around each place under each lag, kept if no lag below is a period."""
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


def scanned(w, **kw):
    ((_, _, ids, at),) = periodic._batches([" ".join(w).encode()])
    return sorted(map(tuple, periodic.scan(ids, at, **kw).tolist()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=40).map(lambda x: x * 3), st.sampled_from([2, 5, 12]))
def test_scan_finds_every_run(w, shortest):
    assert scanned(w, shortest=shortest) == brute_runs(w, shortest)


def test_lag_ranges_show_the_same_runs():
    rng = np.random.default_rng(5)
    w = [str(x) for x in rng.integers(0, 2, 40)] * 3 + ["x"] * 30 + [str(x) for x in rng.integers(0, 3, 50)] * 2
    parts = {r for lo in range(1, len(w) // 2 + 1, 7) for r in scanned(w, first=lo, last=lo + 6)}
    assert sorted(parts, key=lambda r: (r[0], r[2])) == brute_runs(w)


def test_long_equal_words_take_linear_work():
    assert scanned(["a"] * 200_000) == [(0, 200_000, 1)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) < 400}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and len(short) > 100
    for i, t in short.items():
        assert got[i] == brute_row(i, t)
    assert sum(r[1] > 0 for r in got.values()) > 10


@pytest.mark.parametrize("bound", [4 << 20, 20])
def test_awkward_rows_and_dealt_lags(spark, docs, awkward, monkeypatch, bound):
    monkeypatch.setattr(periodic, "DEALT_BYTES", bound)
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    more = docs((31, "a b " * 9), (32, "x y\x0bz " * 6 + "x y"), (33, "one two three " * 3 + "one two"), (planted[0], "p q r s t u v w x y z " * 3), (planted[1], " lead  " + "m n o " * 9), (planted[2], None), (planted[3], " \t"), (34, "日本 語 " * 7))
    table = awkward.filter("doc_id is null or doc_id <> 7").unionByName(more)
    rows = sorted(map(tuple, periodic.run_digest(table).collect()), key=repr)
    assert rows == sorted((brute_row(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=repr)
    runs = periodic.periodic_runs(table, shortest=4)
    assert runs.columns == ["doc_id", "n_words", "runs", "collapsed"] and runs.count() == table.count()
    assert runs.filter("doc_id = 31").first().collapsed == "a b"
    assert periodic.run_digest(docs()).count() == 0

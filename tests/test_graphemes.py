import random
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from kireme.functions import graphemes as G

# a few characters of every class, conjunct scripts included
SAMPLE = "a \r\n\x00­​؀܏ൎ́⃝‌‍️︎ःัำ각가각\U0001f1ef\U0001f1f5क्िষ্ஃ\U0001f468☝\U0001f3fd©本éZXEIiJMoK\U00020000\U000e0061"


def texts(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SAMPLE) for _ in range(rng.randrange(1, length))) for _ in range(n)]


def reference(text):
    return [len(m[0]) for m in regex.finditer(r"\X", text)]


def test_classes_equal_the_regex_module():
    """Break classes of all code points; pictographs of assigned ones."""
    p, letters = G.properties(), [*G.CLASSES]
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    differ = []
    for name in G.BREAKS[1:]:
        want = {ord(c) for m in regex.finditer(rf"\p{{GCB={name}}}+", "".join(map(chr, every))) for c in m[0]}
        got = {c for c in every if G.CLASSES[letters[p[c]]] == name}
        differ += [hex(c) for c in want ^ got]
    assert not differ
    pictures = {ord(c) for m in regex.finditer(r"\p{Extended_Pictographic}+", "".join(map(chr, every))) for c in m[0]}
    # the module's version took characters out of this list
    assert not [hex(c) for c in pictures if letters[p[c]] != "X" and unicodedata.category(chr(c)) != "Cn"]


@pytest.mark.parametrize("seed", range(4))
def test_all_forms_equal_the_regex_module(spark, seed):
    found = texts(400, 14, seed)
    cps = [np.array([*map(ord, t)]) for t in found]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in cps])])
    together = G.breaks(np.concatenate(cps), starts[:-1])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "i int, t string").select("i", G.cluster_sizes(F.col("t")).alias("n"), G.cluster_texts(F.col("t")).alias("c"), G.egc_split(F.col("t")).alias("at"))
    by_row = {r.i: r for r in rows.collect()}
    for i, t in enumerate(found):
        want = reference(t)
        at = np.cumsum([0, *want])
        assert by_row[i].n == want, ascii(t)
        assert by_row[i].c == [t[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == G.clusters(t)
        assert by_row[i].at == [len(t[:k].encode()) for k in at]
        assert np.flatnonzero(together[starts[i] : starts[i + 1]]).tolist() == at[:-1].tolist()
        b = G.Breaker()
        assert [k for k, c in enumerate(t) if b.next(ord(c))] == at[:-1].tolist()
        b.reset()
        assert b.next(ord(t[0]))


def test_long_runs_and_nulls(spark):
    long = ["\U0001f1ef" * 30001, "क" + "्" * 50000 + "क", "\U0001f468‍" * 20000, "a" + "́" * 100000, "x" * 100000]
    rows = spark.createDataFrame([(t,) for t in [*long, "", None]], "t string").select(F.size(G.cluster_sizes(F.col("t"))).alias("n"), G.cluster_sizes(F.col("t")).isNull().alias("none"))
    assert [(r.n, r.none) for r in rows.collect()] == [*((len(reference(t)), False) for t in long), (0, False), (None, True)]
    assert spark.sql("select cast(X'616280' as string) v").select(G.egc_split(F.col("v"))).first()[0] is None


def test_break_test_lines(spark):
    lines = ["÷ 0020 × 0308 ÷ 0020 ÷\t#  ÷ [0.2] SPACE", "# comment", "", "÷ 1F468 × 200D × 1F469 ÷", "÷ 0061 ÷ 1F1E6 × 1F1E7 ÷ 0062 ÷ # x"]
    found = G.break_tests(spark.createDataFrame([(x,) for x in lines], "line string")).select("text", "clusters").collect()
    assert [tuple(r) for r in found] == [(" ̈ ", [2, 1]), ("\U0001f468‍\U0001f469", [3]), ("a\U0001f1e6\U0001f1e7b", [1, 2, 1])]
    table = spark.createDataFrame([(t,) for t in texts(50, 9, 9)], "t string")
    back = G.break_tests(table.select("t", G.break_test_line(F.col("t")).alias("line")))
    assert all(r.text == r.t and r.clusters == reference(r.t) for r in back.collect())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a",)], "t string").select(G.egc_split(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pieces_with_rules_are_short(spark):
    found = ["plain words " * 400 + "e\u0301 \U0001f468\u200d\U0001f469x", "a\u0301b\u0301c d e\u0301", "none", "", "\uffffe\u0301 x", "\r\n x\r\ny", "\U0001f1ef\U0001f1f5 a\U0001f1ef"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "i int, t string").select("i", G._pieces(F.col("t")).alias("p"), G.cluster_sizes(F.col("t")).alias("n"), G.egc_split(F.col("t")).alias("at"))
    for r in rows.collect():
        t, want = found[r.i], reference(found[r.i]) if found[r.i] else []
        assert "".join(r.p) == t and (r.i != 1 or len(r.p) == 1) and r.n == want
        assert r.at == [len(t[:k].encode()) for k in np.cumsum([0, *want])]
        if r.i < 1:
            # what needs no rules is by itself
            assert all(len(p) < 10 or p.isascii() for p in r.p) and len(r.p) > 1

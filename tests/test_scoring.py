import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kireme.operators import relational as R
from kireme.operators.scoring import LinearScorer, NeuralScorer, segments, units
from kireme.operators.trie import Trie
from kireme.plans.segmenter import Segmenter, space_model
from kireme.queries import small_linear_model
from kireme.sources.models import LinearModel
from tests.test_sources import tiny


def test_trie_matches():
    trie = Trie([(5,), (7,), (5, 7)])
    got = sorted((s + n - 1, k) for n, starts, found in trie.matches(np.array([5, 7, 5])) for s, k in zip(starts.tolist(), found.tolist(), strict=True))
    assert got == [(0, 0), (1, 1), (1, 2), (2, 0)]
    assert not list(Trie([(5,)]).matches(np.array([9, 9])))


def test_hand_computed_network():
    s = NeuralScorer(tiny(), "int32")
    score = lambda t: s.scores(units([t], True)).tolist()
    assert score("ああ") == [2530] and score("あい") == [-570] and score("あが") == [-570] and score("あ") == []
    at, start, end = segments(s, ["ああ", "あい", "", "あ"])
    assert at.tolist() == [0, 2, 3, 3, 4] and start.tolist() == [0, 3, 0, 0] and end.tolist() == [3, 6, 6, 3]


def naive_int16(m, text):
    """Ordered saturating sums, boundary by boundary."""
    s, q = NeuralScorer(m), NeuralScorer(m, "int32")
    u = units([text], True)
    rows = s.row_of[u.cps]
    where, feature = s.features(u)
    clip = lambda v: np.clip(v, -32768, 32767)
    small = lambda v: clip((np.asarray(v, np.int64) + 256) >> 9)
    out = []
    for b in range(u.n - 1):
        acc = small(q.b1_q)
        for j in range(2 * m.window):
            i = b - m.window + 1 + j
            cluster = tuple(rows[u.unit_at[i] : u.unit_at[i + 1]].tolist()) if 0 <= i < u.n else (0,)
            acc = clip(acc + small(q.block(cluster, j)))
        for f in feature[where == b]:
            acc = clip(acc + small(q.dict_q[:, f]))
        out.append(int(np.maximum(acc, 0) @ m.w2.astype(np.int64)) + ((q.b2_q + 256) >> 9))
    return out


@settings(max_examples=40, deadline=None)
@given(st.text("あいが x", max_size=12), st.integers(0, 5))
def test_saturating_scorer(text, seed):
    rng = np.random.default_rng(seed)
    m = tiny()
    m.emb = rng.integers(-32000, 32000, m.emb.shape).astype(np.int16)
    m.w1 = rng.integers(-32000, 32000, m.w1.shape).astype(np.int16)
    m.acc_scale = 1e-7
    assert NeuralScorer(m).scores(units([text], True)).tolist() == naive_int16(m, text)


def test_dictionary_features():
    def of(words, text):
        m = tiny()
        m.dictionaries = words
        m.wdict = np.zeros((1, 12 * len(words)), np.int16)
        where, feature = NeuralScorer(m, "int32").features(units([text], True))
        return [feature[where == b].tolist() for b in range(max(units([text], True).n - 1, 0))]

    assert of([["か"]], "か本") == [[8]] and of([["か"]], "が本") == [[]]
    assert of([["日本"]], "日本語") == [[5], [9]] and of([["日本"], ["日本"]], "日本語") == [[5, 17], [9, 21]]
    assert of([["あいうえお"]], "あいうえおX")[3:] == [[7], [11]]
    assert of([["日", "日本", "本語"]], "日本語") == [[1, 5, 8], [5, 9]] and of([["", "日本"]], "日本語")[0] == [5]


def naive_linear(m: LinearModel, text: str) -> list[int]:
    from kireme.functions.text import NORMALIZED, TYPE_RANGES

    t = "".join(NORMALIZED.get(c, c) for c in text)
    types = "".join(next((k for k, r in TYPE_RANGES.items() if any(a <= ord(c) <= b for a, b in r)), "O") for c in t)
    n = len(t)
    out = [m.bias] * max(n - 1, 0)
    for source, patterns, w in ((t, m.char_patterns, m.char_window), (types, m.type_patterns, m.type_window)):
        for g, vec in patterns.items():
            for s in range(n - len(g) + 1):
                if source[s : s + len(g)] == g:
                    for j, v in enumerate(vec):
                        b = s + len(g) - 1 - w + j
                        if 0 <= b < n - 1:
                            out[b] += int(v)
    seen = set()
    for word, bits in m.words.items():
        k = min(len(word), m.dict_n) - 1
        for s in range(n - len(word) + 1):
            if t[s : s + len(word)] == word:
                for c in range(8):
                    if bits >> c & 1:
                        places = [(s - 1, 0), *((b, 1) for b in range(s, s + len(word) - 1)), (s + len(word) - 1, 2)]
                        seen |= {(b, c * 3 * m.dict_n + k * 3 + p) for b, p in places if 0 <= b < n - 1}
    for b, f in seen:
        out[b] += int(m.dict_vector[f])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("thesr d.", max_size=14), max_size=4))
def test_linear_scorer(texts):
    m = small_linear_model()
    assert LinearScorer(m).scores(units(texts, False)).tolist() == [x for t in texts for x in naive_linear(m, t)]


def test_partitions_do_not_change_results(spark):
    lines = R.lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).limit(300).cache()
    found = [sorted(map(tuple, Segmenter(spark, small_linear_model()).format_lines(lines.repartition(n)).select("doc_id", "line_no", "line").collect())) for n in (1, 2, 8)]
    assert found[0] == found[1] == found[2]


def test_words_tile_the_text_and_errors(spark):
    s = Segmenter(spark, space_model(), "int32")
    rows = spark.createDataFrame([(1, "a b  ç/"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r for r in s.transform(rows).collect()}
    assert [(w.start, w.end) for w in got[1].words] == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 8)]
    assert got[2].words == [] and got[3].words is None and got[1].error is None
    bad = spark.sql("select cast(X'61ff' as string) text")
    row = s.transform(bad).select("words", "error").first()
    assert row.error == "InvalidUtf8" and row.words is None
    assert s.format_lines(rows).filter("id = 1").first().line == "a \\  b \\ \\  ç\\/"
    s.register("seg")
    assert spark.sql("select size(seg('a b'))").first()[0] == 3
    assert [tuple(r) for r in spark.sql("select w.* from (select 'a b' t), lateral seg_words(t) w").collect()] == [(0, 0, 1, "a"), (1, 1, 2, " "), (2, 2, 3, "b")]


def test_metrics(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "line_no int, line string")
    row = R.boundary_metrics(lines("a bc d", "x"), lines("a b cd", "x")).first()
    assert (row.precision, row.recall, row.gold_boundaries, row.sentences) == (0.5, 0.5, 2, 2)
    empty = R.boundary_metrics(lines("ab"), lines("ab")).first()
    assert (empty.precision, empty.recall) == (1.0, 1.0)
    none = R.confusion_metrics(spark.createDataFrame([(0, False)], "label int, cut boolean")).first()
    assert none.precision == none.recall == none.f1 == 0.0 and none.accuracy == 1.0
    assert tuple(R.differing_lines(lines("a", "b"), lines("a", "c")).first()) == (2, 1)
    assert R.byte_offsets(R.lines(spark.createDataFrame([(1, "é")], "doc_id int, text string"))).select(F.max("byte_end")).first()[0] == 2

import numpy as np
import pytest
from pyspark.sql import functions as F

from kireme import network_queries as Q
from kireme.functions.arrays import running_sums
from kireme.operators import relational as R
from kireme.operators import scoring

LINES = ["", "x", "thé ńe té is  there", "\U0001f468‍\U0001f469t né nini s is t", "नि" * 30 + "én" * 20, "ab" * 200]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(LINES)], "doc_id long, line_no long, text string")


@pytest.mark.parametrize("precision", ["int32", "int16"])
def test_cluster_network_equals_the_arrow_scorer(spark, lines, precision):
    m = Q.cluster_model()
    scorer = scoring.NeuralScorer(m, precision)
    u = scoring.units(LINES, True)
    want, at = scorer.scores(u).tolist(), 0
    for r in R.network_lines(lines, m, precision).sort("line_no").collect():
        n = max(0, len(r.units) - 1)
        assert r.scores == want[at : at + n]
        at += n
    assert at == len(want)


def test_dictionary_hits_of_any_length(spark, lines, monkeypatch):
    words = ["t", "th", "thé", "is", "ab" * 13, "ab" * 40, "ba", "x", "नि" * 25, "absent"]
    table = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)] + [("t", 2), ("", 1)], "word string, channel int")
    want = sorted({(i, s, len(w), c) for i, t in enumerate(LINES) for w, c in [(w, i % 3) for i, w in enumerate(words)] + [("t", 2)] for s in range(len(t)) if t.startswith(w, s)})
    rows = R.normalized_units(lines).withColumn("units", F.split(F.translate(F.array_join("units", ""), "".join(R.normalize.__globals__["NORMALIZED"].values()), "".join(R.normalize.__globals__["NORMALIZED"])), ""))
    for walked, bound in ((24, 3_000_000), (2, 3_000_000), (24, 0)):
        monkeypatch.setattr(R, "WALKED", walked)
        monkeypatch.setattr(R, "BROADCAST_PREFIXES", bound)
        found = R.dictionary_hits(rows, table, max(map(len, words)))
        assert sorted((r.line_no, r.start, r.len, r.channel) for r in found.collect()) == want
    assert R.dictionary_hits(rows, table.limit(0), 5).count() == 0


def test_clusters_decide_where_words_match(spark, lines):
    table = spark.createDataFrame([("n", 0), ("ne", 0), ("ｅ́", 1)], "word string, channel int").select(R.normalize(F.col("word")).alias("word"), "channel")
    found = R.dictionary_hits(R.normalized_units(lines, True), table, 2)
    # a mark after the letter makes another cluster
    assert {(r.line_no, r.channel) for r in found.collect()} == {(2, 1), (3, 0), (3, 1), (4, 0), (4, 1)}


def test_work_of_a_line_stays_in_its_row(spark, lines):
    rows = lines.select(*R.KEYS, F.transform(F.split("text", ""), F.ascii).alias("rows"))
    scores = R.network_scores(F.split(R.normalize(F.col("text")), ""), Q.cluster_model())
    for df in (R.byte_offsets(lines), R.type_runs(lines), R.window_slots(rows, 3), R.words_from_cuts(lines, F.transform(scores, lambda s: s > 0))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Window" not in plan


def test_words_and_offsets(spark):
    df = spark.createDataFrame([(1, 0, "aé日b"), (1, 1, "z"), (2, 0, "")], "doc_id long, line_no long, text string")
    cuts = F.when(F.col("line_no") == 0, F.array(F.lit(True), F.lit(False), F.lit(True))).otherwise(F.expr("cast(array() as array<boolean>)"))
    words = [tuple(r) for r in R.words_from_cuts(df, cuts).sort("doc_id", "line_no", "word_idx").collect()]
    assert words == [(1, 0, 0, 0, 1, "a"), (1, 0, 1, 1, 6, "é日"), (1, 0, 2, 6, 7, "b"), (1, 1, 0, 0, 1, "z")]
    assert [(r.byte_start, r.byte_end) for r in R.byte_offsets(df).filter("line_no = 0").sort("pos").collect()] == [(0, 1), (1, 3), (3, 6), (6, 7)]


def test_running_sums_of_any_size(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 31, 32, 33, 1024, 1025, 40_000):
        x = rng.integers(-5, 9, n).tolist()
        row = spark.createDataFrame([(x,)], "x array<long>").select(running_sums(F.col("x")).alias("s")).first()
        assert row.s == np.cumsum(x).tolist()


def test_flat_scores_equal_the_arrow_scorer(spark, lines):
    from kireme.queries import saturating_model
    from kireme.plans.segmenter import space_model

    for m in (saturating_model(), space_model()):
        u = scoring.units(LINES, False)
        want = scoring.NeuralScorer(m, "int32").scores(u).tolist()
        assert R._flat_score(m) is not None
        rows = R.neural_scores(lines, m)
        assert [r.score for r in rows.sort("line_no", "boundary").collect()] == want
        # gaps are scored in generated code, not by functions on inner arrays
        assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()
        arrays = lines.select("line_no", R.network_scores(F.split(R.normalize(F.col("text")), ""), m, single=True).alias("s"))
        assert [x for r in arrays.sort("line_no").collect() for x in r.s] == want
    assert R._flat_score(Q.cluster_model()) is None


def test_offsets_are_summed_over_runs(spark):
    text = "a" * 90_000 + "é" * 3 + "日\U0001f468x" + "ñb" * 5
    rows = R.byte_offsets(spark.createDataFrame([(1, 0, text)], "doc_id long, line_no long, text string")).sort("pos").collect()
    ends = np.cumsum([len(c.encode()) for c in text]).tolist()
    assert [(r.pos, r.ch, r.byte_end) for r in rows] == [(i, c, e) for i, (c, e) in enumerate(zip(text, ends, strict=True))]
    assert [r.byte_start for r in rows] == [0, *ends[:-1]]


def test_counted_grams_and_type_letters(spark, lines):
    from kireme.functions.text import char_type, type_letters

    every = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).filter("c <> ''")
    assert every.filter(type_letters(F.col("c")) != char_type(F.ascii(R.normalize(F.col("c"))))).count() == 0
    for source in ("norm", "type"):
        want = R.ngrams(lines, 3, source).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, R.ngram_counts(lines, 3, source).collect())) == sorted(map(tuple, want.collect()))


def test_gap_lists(spark):
    pairs = spark.sql("select array(named_struct('boundary', 2, 'feature', 10), named_struct('boundary', 0, 'feature', 9), named_struct('boundary', 2, 'feature', 3), named_struct('boundary', 2, 'feature', 10)) p, 4 n")
    assert pairs.select(R.gap_lists(F.col("p"), F.col("n"))).first()[0] == [[9], [], [3, 10], []]
    assert pairs.select(R.gap_lists(F.expr("slice(p, 1, 0)"), F.lit(1)), R.gap_lists(F.expr("slice(p, 1, 0)"), F.lit(0))).first()[:] == ([[]], [])

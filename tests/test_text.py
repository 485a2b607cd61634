import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kireme.functions import graphemes, numeric
from kireme.functions.text import NORMALIZED, char_type, escape_word, normalize, unescape, unescape_words


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_normalization(spark):
    assert len(NORMALIZED) == 96
    assert one(spark, normalize, "aZ0(?-。あ漢 𠀋") == "ａＺ０（？−。あ漢 𠀋"


def test_types(spark):
    text = "aZａあア・09９水、 𠀋"
    assert one(spark, lambda v: F.array_join(F.transform(F.split(v, ""), lambda c: char_type(F.ascii(c))), ""), text) == "RRRHTODDDKOOK"


def test_clusters(spark):
    cases = {"日本語abc": 6, "が": 1, "a\r\nb": 3, "\U0001f468‍\U0001f469‍\U0001f466": 1, "🇯🇵🇯🇵": 2, "क्षि": 1, "각": 1, "": 0}
    for text, n in cases.items():
        assert len(graphemes.clusters(text)) == n
        assert one(spark, graphemes.egc_split, text)[-1] == len(text.encode())
        assert len(graphemes.cluster_starts(text)) == n
    assert spark.sql("select cast(X'616280' as string) v").select(graphemes.egc_split(F.col("v"))).first()[0] is None


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_simple_text_has_one_cluster_per_character(text):
    text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
    assert graphemes.cluster_starts(text).tolist() == [m.start() for m in regex.finditer(r"\X", text)]


def test_property_table(spark):
    t = graphemes.property_table(spark)
    assert t.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] == 0x110000
    assert t.filter("lo <= 13 and hi >= 13").first().gcb == "CR"


def test_escapes(spark):
    words = ["a b", "c/d", "", "\\", "&x"]
    line = " ".join(w.replace("\\", "\\\\").replace(" ", "\\ ").replace("/", "\\/").replace("&", "\\&") for w in words)
    assert unescape(line) == words
    assert unescape(line, keep_empty=False) == [w for w in words if w]
    assert one(spark, unescape_words, line) == words
    assert one(spark, unescape_words, "a\\") == unescape("a\\") == ["a\\"]
    assert one(spark, escape_word, "a /&\\") == "a\\ \\/\\&\\\\"


def test_integer_arithmetic(spark):
    got = spark.createDataFrame([(v,) for v in (400, -200, 1 << 30, -(1 << 30), -1000)], "v long").select(numeric.requant_i16(F.col("v"))).collect()
    assert [r[0] for r in got] == [1, 0, 32767, -32768, -2]
    assert numeric.requant([400, -200, 1 << 30]).tolist() == [1, 0, 32767]
    assert numeric.round_away(np.array([-0.5, 2.5, 0.49999999999999994])).tolist() == [-1, 3, 0]
    assert numeric.add_saturated(np.array([32767, 32767, -32768, 100], np.int16), np.array([1, 32767, -1, -50])).tolist() == [32767, 32767, -32768, 50]
    q = spark.range(1).select(numeric.fused_i16(F.array(F.lit(30000)), F.array(F.array(F.lit(10000)), F.array(F.lit(-10000))), F.array(F.lit(2)))).first()[0]
    assert q == 2 * (32767 - 10000)
    y = spark.range(1).select(numeric.bce(F.lit(-3.0), F.lit(1.0))).first()[0]
    assert abs(y - np.log1p(np.exp(3))) < 1e-12


def test_running_sums(spark):
    from kireme.functions.arrays import running_sums

    for n in (0, 1, 31, 32, 33, 200):
        assert spark.createDataFrame([(list(range(n)),)], "v array<long>").select(running_sums(F.col("v"))).first()[0] == np.cumsum(range(n)).tolist()

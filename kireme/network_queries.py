"""Queries of training steps and clusters over the test tables, and the SQL that checks them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kireme.functions.graphemes import break_test_line, break_tests, cluster_sizes, cluster_texts
from kireme.functions.references import unescape_references
from kireme.functions.text import chars
from kireme.operators import relational as R
from kireme.plans import steps
from kireme.plans.network import Parameters
from kireme.sources.corpus import conllu_sentences
from kireme.sources.models import NeuralModel

SHAPE = steps.Shape(window=2, dim=2, hidden=3)
VOWELS = "aeiou"


def start_values() -> Parameters:
    """Fixed parameters, each a function of its place."""
    at = lambda n, m, a, b, k: np.array([[((i * a + j * b) % k - k // 2) / 16 for j in range(m)] for i in range(n)])
    w1 = at(SHAPE.slots * SHAPE.hidden, SHAPE.dim, 5, 3, 13)
    own = w1.reshape(SHAPE.slots, SHAPE.hidden, SHAPE.dim).transpose(1, 0, 2).reshape(SHAPE.hidden, -1)
    return Parameters(at(16, SHAPE.dim, 7, 5, 11), own, at(12, SHAPE.hidden, 3, 1, 7).T, np.array([-1, 0, 1]) / 32, np.array([-1, 1, 3]) / 8, np.array([1 / 32]))


def _start(spark: SparkSession, model: str = "") -> DataFrame:
    return steps.parameter_table(spark, start_values(), model)


def turn_examples(spark: SparkSession, sf_dir: str, model: str = "", where: str = "true") -> DataFrame:
    """Examples of the gaps of turns' texts: does a blank follow? A capital letter is a cluster of two rows, vowels beside the gap are features.

    An example hangs on the characters around its gap alone, so equal windows are counted first and are one row with their number, ``times``.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(where).filter("length(text) > 1").select(F.split("text", "").alias("c"))
    gaps = turns.select("c", F.explode(F.sequence(F.lit(0), F.size("c") - 2)).alias("p"))
    places = range(1 - SHAPE.window, SHAPE.window + 1)
    near = {o: f"c{o + SHAPE.window}" for o in places}
    windows = gaps.select(*[F.when(F.col("p") + o >= 0, F.get("c", F.col("p") + o)).alias(near[o]) for o in places]).groupBy(*near.values()).agg(F.count(F.lit(1)).alias("times"))

    def rows(ch: Column) -> Column:
        own = F.ascii(ch) % 13 + 2
        return F.when(ch.isNull(), F.array(F.lit(0))).when(ch.between("A", "Z"), F.array(own, F.lit(15))).otherwise(F.array(own))

    slots = F.array(*[rows(F.col(near[o])) for o in places])
    vowel = lambda o, feature: F.when(F.col(near[o]).isin(*VOWELS), F.lit(feature))
    examples = windows.select(F.lit(model).alias("model"), (F.col(near[1]) == " ").cast("int").alias("label"), slots.alias("slots"), F.array_compact(F.array(vowel(0, 3), vowel(1, 7))).alias("features"), "times")
    return steps.merged(examples)


def _values(params: DataFrame) -> DataFrame:
    rows = params.select("model", "name", F.col("at").cast("long").alias("at"), F.posexplode("vec").alias("i", "value"))
    return rows.select("model", "name", "at", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


def train_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters after one step of gradient descent over all examples, and the mean loss before it."""
    params, examples = _start(spark), turn_examples(spark, sf_dir)
    grads = steps.gradients(examples, params, SHAPE)
    return _values(steps.sgd_step(params, grads, 5.0).unionByName(grads.filter("name = 'loss'")))


def adam_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters after one step of Adam over the first turns; embedding rows that they lack stay."""
    params = _start(spark)
    grads = steps.gradients(turn_examples(spark, sf_dir, where="turn = 0"), params, SHAPE)
    return _values(steps.adam_step(params, steps.adam_start(params), grads, 0.01, decay=0.5)[0])


def train_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = steps.forward(turn_examples(spark, sf_dir), _start(spark), SHAPE)
    return R.confusion_metrics(passed.select("label", (F.col("y") > 0).alias("cut"), "times"), times="times")


def _diffused(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    params = steps.signed_start(_start(spark, rule), SHAPE.hidden)
    return steps.diffusion_step(turn_examples(spark, sf_dir, rule), params, SHAPE, rule, 5.0, 1.0, 0.01)


def diffusion_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and feedback after one step of either rule of error diffusion: gradient, step, projection, tracking."""
    return _values(_diffused(spark, sf_dir, "hybrid").unionByName(_diffused(spark, sf_dir, "pure")))


def diffusion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps.diffusion_state(_diffused(spark, sf_dir, "hybrid"))
    return found.select("model", "pinned", F.round("gap", 6).alias("gap"))


def _step_sql(rule: str, where: str, result: str) -> str:
    """The step in long form: every number a row. ``result`` reads p (parameters), d (gradients) and y (logits)."""
    diffused = rule != "backpropagation"
    w2 = "abs((i * 2 - 1) / 8e0) * (CASE WHEN i < 1 THEN 1 ELSE -1 END)" if diffused else "(i * 2 - 1) / 8e0"
    feedback = "UNION ALL SELECT 'feedback', 0, i, CASE WHEN i < 1 THEN 1e0 ELSE -1e0 END FROM range(3) b(i)" if diffused else ""
    d_x = "SELECT ex, slot, i, e * (CASE WHEN i < 1 THEN 1 ELSE -1 END) AS dx FROM er, range(4) s(slot), range(2) b(i)" if rule == "pure" else "SELECT ex, at // 3 AS slot, i, sum(da * v) AS dx FROM da JOIN p ON name = 'w1' AND at % 3 = h GROUP BY ALL"
    sql = f"""WITH p AS MATERIALIZED (SELECT 'emb' AS name, at, i, ((at * 7 + i * 5) % 11 - 5) / 16e0 AS v FROM range(16) a(at), range(2) b(i)
UNION ALL SELECT 'w1', at, i, ((at * 5 + i * 3) % 13 - 6) / 16e0 FROM range(12) a(at), range(2) b(i)
UNION ALL SELECT 'wdict', at, i, ((at * 3 + i) % 7 - 3) / 16e0 FROM range(12) a(at), range(3) b(i)
UNION ALL SELECT 'b1', 0, i, (i - 1) / 32e0 FROM range(3) b(i) UNION ALL SELECT 'w2', 0, i, {w2} FROM range(3) b(i) UNION ALL SELECT 'b2', 0, 0, 1 / 32e0 {feedback}),
t AS MATERIALIZED (SELECT text, row_number() OVER () AS r FROM conversations WHERE length(text) > 1 AND {where}),
g AS MATERIALIZED (SELECT r * 1000000 + q AS ex, text, q, CASE WHEN substr(text, q + 1, 1) = ' ' THEN 1 ELSE 0 END AS label FROM (SELECT *, unnest(range(1, length(text))) AS q FROM t)),
c AS (SELECT ex, slot, CASE WHEN q + slot - 1 < 1 THEN '' ELSE substr(text, q + slot - 1, 1) END AS ch FROM g, range(4) s(slot)),
sr AS MATERIALIZED (SELECT ex, slot, unnest(rows) AS row, len(rows) AS n FROM (SELECT ex, slot, CASE WHEN ch = '' THEN [0] WHEN ch BETWEEN 'A' AND 'Z' THEN [unicode(ch) % 13 + 2, 15] ELSE [unicode(ch) % 13 + 2] END AS rows FROM c)),
f AS MATERIALIZED (SELECT ex, 3 AS feature FROM g WHERE contains('{VOWELS}', substr(text, q, 1)) UNION ALL SELECT ex, 7 FROM g WHERE contains('{VOWELS}', substr(text, q + 1, 1))),
x AS MATERIALIZED (SELECT ex, slot, i, avg(v) AS x FROM sr JOIN p ON name = 'emb' AND at = row GROUP BY ALL),
a AS MATERIALIZED (SELECT ex, h, sum(v) AS a FROM (SELECT ex, at % 3 AS h, v * x AS v FROM x JOIN p ON name = 'w1' AND at // 3 = slot AND p.i = x.i UNION ALL SELECT ex, i, v FROM f JOIN p ON name = 'wdict' AND at = feature UNION ALL SELECT ex, i, v FROM g, p WHERE name = 'b1') GROUP BY ALL),
y AS MATERIALIZED (SELECT ex, sum(greatest(a, 0) * v) + 1 / 32e0 AS y FROM a JOIN p ON name = 'w2' AND i = h GROUP BY ex),
er AS MATERIALIZED (SELECT ex, y, label, 1 / (1 + exp(-y)) - label AS e FROM y JOIN g USING (ex)),
da AS MATERIALIZED (SELECT ex, h, CASE WHEN a > 0 THEN e * v ELSE 0 END AS da FROM a JOIN er USING (ex) JOIN p ON name = '{"feedback" if diffused else "w2"}' AND i = h),
dx AS ({d_x}),
d AS MATERIALIZED (SELECT name, at, i, s / (SELECT count(*) FROM g) AS d FROM (SELECT 'w1' AS name, slot * 3 + h AS at, i, sum(da * x) AS s FROM da JOIN x USING (ex) GROUP BY ALL
UNION ALL SELECT 'emb', row, i, sum(dx / n) FROM dx JOIN sr USING (ex, slot) GROUP BY ALL UNION ALL SELECT 'wdict', feature, h, sum(da) FROM da JOIN f USING (ex) GROUP BY ALL
UNION ALL SELECT 'b1', 0, h, sum(da) FROM da GROUP BY ALL UNION ALL SELECT 'w2', 0, h, sum(greatest(a, 0) * e) FROM a JOIN er USING (ex) GROUP BY ALL UNION ALL SELECT 'b2', 0, 0, sum(e) FROM er
UNION ALL SELECT 'loss', 0, 0, sum(greatest(y, 0) - y * label + ln(1 + exp(-abs(y)))) FROM er)),
n AS MATERIALIZED (SELECT name, at, i, v, coalesce(d, 0) AS d, d IS NOT NULL AS seen FROM p LEFT JOIN d USING (name, at, i))
{result}"""
    # a word of the dialect
    return re.sub(r"\bat\b", '"at"', sql)


_ROW = "name, CAST(at AS BIGINT) AS at, CAST(i AS BIGINT) AS i"
_MOVED = "q AS (SELECT name, at, i, v, CASE WHEN name = 'w2' AND (v - 5 * d) * (CASE WHEN i < 1 THEN 1 ELSE -1 END) < 0 THEN 0 ELSE v - 5 * d END AS m FROM n), w AS (SELECT i, m - v AS change FROM q WHERE name = 'w2'), z AS (SELECT q.name, q.at, q.i, CASE WHEN name = 'feedback' THEN (m + change) * 0.99e0 WHEN name = 'w2' THEN m * 0.99e0 ELSE m END AS u FROM q LEFT JOIN w ON q.i = w.i)"


def break_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as lines of a break test file and back: how many clusters and characters each line has."""
    words = _clustered_words(spark, sf_dir).select(F.explode(F.array(F.concat(break_test_line(F.col("word")), F.lit("\t# "), F.col("word")))).alias("line"))
    found = break_tests(words)
    return found.select(F.col("text").alias("word"), F.size("clusters").cast("long").alias("n"), F.array_join(F.col("clusters").cast("array<string>"), ",").alias("sizes"))


#: Stand-ins that put all kinds of joining characters into words: marks, conjuncts, pictographs, jamo, flags, prepended signs.
STAND_INS = {"a": "ạ́", "th": "क्ष", "er": "\U0001f468‍\U0001f469‍\U0001f467", "s": "각", "o": "\U0001f1ef\U0001f1f5\U0001f1eb", "i": "กำ", "u": "؀u", "n": "नि", "d": "각", "l": "☝\U0001f3fd", "c": "ক্‍ষ"}


def _replaced(text: Column) -> Column:
    for a, b in STAND_INS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _clustered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = R.lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''").distinct()
    return words.select(_replaced(F.col("word")).alias("word"))


def word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all distinct words with stand-ins for some letters."""
    return _clustered_words(spark, sf_dir).select("word", F.array_join(cluster_texts(F.col("word")), "|").alias("clusters"), F.size(cluster_sizes(F.col("word"))).cast("long").alias("n"))


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of gaps between clusters: words that begin with a mark put a word boundary inside a cluster, gaps behind ``u`` are unknown."""
    lines = R.lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.filter(F.split("text", " "), lambda w: w != "")
    marked = F.transform(words, lambda w: F.replace(F.when(w.startswith("e"), F.concat(F.lit("́"), w)).otherwise(w), F.lit("o"), F.lit("ö")))
    tags = lambda w, i: F.concat(F.array_repeat(F.lit(1), F.when(i > 0, 1).otherwise(0)), F.transform(F.slice(F.split(w, ""), F.lit(1), F.char_length(w) - 1), lambda c: F.when(c != "u", F.lit(0))))
    sentences = lines.select(*R.KEYS, marked.alias("w")).filter("size(w) > 0").select(*R.KEYS, F.array_join("w", "").alias("text"), F.flatten(F.transform("w", tags)).cast("array<tinyint>").alias("tags"))
    found = R.cluster_labels(sentences)
    count = lambda test: F.size(F.filter("labels", test)).cast("long")
    return found.select(*R.KEYS, "status", count(lambda t: t.isNotNull()).alias("examples"), count(lambda t: t == 1).alias("bound"), count(lambda t: t.isNull()).alias("unknown"), F.col("inside").cast("long").alias("inside"))


def _stand_in_sql(text: str) -> str:
    for a, b in STAND_INS.items():
        text = f"replace({text}, '{a}', '{b}')"
    return text


_LINES = "l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)))"
_WORDS = f"{_LINES}, v AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM l), w AS (SELECT {_stand_in_sql('word')} AS word FROM v WHERE word <> '')"
_PARTS = "list_transform(range(1, length_grapheme(word) + 1), lambda k: substring_grapheme(word, k, 1))"

def order_treebank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a few long treebank files: a blank line ends a sentence after every order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("path"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.concat(F.lit("p"), "l_partkey").alias("surface"), "l_suppkey")
    field = F.concat_ws("\t", F.col("n").cast("string"), "surface", F.lit("_"), F.lit("_"), F.col("l_suppkey").cast("string"), *[F.lit("_")] * 4, F.concat(F.lit("UnidicInfo="), F.upper("surface")))
    tokens = items.select("path", (F.col("o") * 10 + F.col("n")).cast("long").alias("line_no"), field.alias("text"))
    ends = items.select("path", "o").distinct().select("path", (F.col("o") * 10 + 9).cast("long").alias("line_no"), F.lit(" \r").alias("text"))
    return conllu_sentences(tokens.unionByName(ends))


def character_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose characters are written as references (numbers, hexadecimal numbers, names) and read back."""
    lines = R.lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = {"&": "amp;", "<": "lt", ">": "gt;", "é": "eacute", "ü": "uuml;", "ß": "szlig;", "ñ": "ntilde;", ".": "period;", ",": "comma;", "(": "lpar;"}
    named = lambda c: F.concat(F.lit("&"), F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c))
    written = lambda c, i: F.when(i % 3 == 0, F.concat(F.lit("&#"), F.ascii(c), F.lit(";"))).when(i % 3 == 1, F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(c))), F.lit(";"))).when(c.isin(*names), named(c)).otherwise(c)
    return lines.select(*R.KEYS, unescape_references(F.array_join(F.transform(chars(F.col("text")), written), "")).alias("text"))


# characters of the network below: letters, an accent, and a few of the stand-ins
VOCABULARY = sorted(ord(c) for c in "ｅｎｒｓｔ\u0301\u200dनि \U0001f468")
_LISTS = (["ne", "e\u0301n", "is", "te\u0301", "s "], ["ne", "\U0001f468\u200d\U0001f469t", "is t", "ni"])


def cluster_model() -> NeuralModel:
    """A network of window 3 with 8 units and two dictionaries, each number a function of its place."""
    h, w, d, v = 8, 3, 2, len(VOCABULARY) + 2
    at = lambda shape, f: np.array([f(*i) for i in np.ndindex(shape)], np.int16).reshape(shape)
    unit = 2.0**-23
    return NeuralModel(
        w, VOCABULARY, at((v, d), lambda r, k: (r * 7 + k * 5) % 11 - 5), at((h, 2 * w, d), lambda j, s, k: (s * 5 + j * 3 + k * 7) % 13 - 6), (np.arange(h) - 3) * 51200 * unit,
        (np.arange(h) * 5 % 7 - 3).astype(np.int16), 0.5 * unit * 25600, 2.0**-4, 2.0**-3, 0.5, unit, at((h, 24), lambda j, f: ((f * 3 + j) % 7 - 3) * 1500), unit * 512, [*_LISTS],
    )


def _cluster_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with marks, joined pictographs and conjuncts for some letters."""
    text = F.replace(F.replace(F.replace("text", F.lit("e"), F.lit("e\u0301")), F.lit("o"), F.lit("\U0001f468\u200d\U0001f469")), F.lit("a"), F.lit("नि"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text <> ''").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("line_no"), text.alias("text"))


def _cluster_totals(spark: SparkSession, sf_dir: str, precision: str) -> DataFrame:
    found = R.network_lines(_cluster_items(spark, sf_dir), cluster_model(), precision)
    count = lambda test: F.size(F.filter("scores", test)).cast("long")
    weighted = F.aggregate(F.transform("scores", lambda s, g: s * (g % 5 + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(F.col("doc_id").alias("item_id"), F.size("scores").cast("long").alias("gaps"), count(lambda s: s > 0).alias("cuts"), F.aggregate("scores", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), weighted.alias("weighted")).filter("gaps > 0")


def cluster_network_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scores over clusters of several characters and two dictionaries."""
    return _cluster_totals(spark, sf_dir, "int32")


def cluster_network_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in 16 bits, parts added in their order and clamped after each."""
    return _cluster_totals(spark, sf_dir, "int16")


def _network_sql(clamped: bool) -> str:
    """The network with windows as slices of a list of clusters, dictionary features from every stretch of clusters, and a fold over lists."""
    from kireme.functions.text import NORMALIZED

    a, b = "".join(NORMALIZED).replace("'", "''"), "".join(NORMALIZED.values())
    norm = lambda x: "".join(NORMALIZED.get(c, c) for c in x)
    words = ", ".join(f"('{norm(w)}', {c})" for c, ws in enumerate(_LISTS) for w in ws)
    cps = ", ".join(f"({cp}, {i + 2})" for i, cp in enumerate(VOCABULARY))
    part = "least(greatest((p + 256) >> 9, -32768), 32767)" if clamped else "p"
    add = "greatest(least(a + b, 32767), -32768)" if clamped else "a + b"
    scale = 1 if clamped else 512
    b2 = 50 if clamped else 25600
    return f"""WITH v(cp, row) AS (VALUES {cps}), words(word, channel) AS (VALUES {words}),
t AS MATERIALIZED (SELECT item_id, row_number() OVER () AS r, translate(text, '{a}', '{b}') AS text FROM (SELECT item_id, replace(replace(replace(text, 'e', 'é'), 'o', '👨‍👩'), 'a', 'नि') AS text FROM benchmark WHERE text <> '')),
u AS MATERIALIZED (SELECT *, list_transform(range(1, length_grapheme(text) + 1), lambda k: substring_grapheme(text, k, 1)) AS u FROM t),
k AS MATERIALIZED (SELECT DISTINCT unnest(u) AS c FROM u),
kc AS (SELECT c, unnest(string_split(c, '')) AS ch, length(c) AS n FROM k),
kv AS MATERIALIZED (SELECT c, any_value(n) AS n, i AS d, sum((coalesce(row, 1) * 7 + i * 5) % 11 - 5) AS s FROM (SELECT * FROM kc LEFT JOIN v ON unicode(ch) = cp), range(2) x(i) GROUP BY c, d UNION ALL SELECT '', 1, i, (i * 5) % 11 - 5 FROM range(2) x(i)),
kp AS MATERIALIZED (SELECT c, slot, h, CAST(sign(x) * floor(abs(x) + 0.5) AS BIGINT) AS p FROM (SELECT c, slot, h, sum(s * ((slot * 5 + h * 3 + d * 7) % 13 - 6)) * (65536e0 / any_value(n)) AS x FROM kv, range(6) s(slot), range(8) y(h) GROUP BY c, slot, h)),
kb AS MATERIALIZED (SELECT c, slot, list({part} ORDER BY h) AS p FROM kp GROUP BY c, slot),
g AS MATERIALIZED (SELECT r, u, g FROM (SELECT r, u, unnest(range(0, len(u) - 1)) AS g FROM u)),
s AS (SELECT r, g, slot, CASE WHEN g + slot - 2 < 0 OR g + slot - 2 >= len(u) THEN '' ELSE u[g + slot - 1] END AS c FROM g, range(6) y(slot)),
h0 AS (SELECT r, len(u) AS n, i, k, array_to_string(u[i + 1:i + k], '') AS gram FROM (SELECT r, u, i, unnest(range(1, least(4, len(u) - i) + 1)) AS k FROM (SELECT r, u, unnest(range(0, len(u))) AS i FROM u))),
m AS MATERIALIZED (SELECT r, n, i, k, channel FROM h0 JOIN words ON gram = word),
f AS MATERIALIZED (SELECT DISTINCT r, g, channel * 12 + pos * 4 + least(k, 4) - 1 AS f FROM (SELECT r, n, k, channel, i - 1 AS g, 0 AS pos FROM m UNION ALL SELECT r, n, k, channel, unnest(range(i, i + k - 1)), 1 FROM m UNION ALL SELECT r, n, k, channel, i + k - 1, 2 FROM m) WHERE g >= 0 AND g < n - 1),
a AS (SELECT r, g, slot AS o, p FROM s JOIN kb USING (c, slot) UNION ALL SELECT r, g, 100 + f, list_transform(range(8), lambda h: ((f * 3 + h) % 7 - 3) * 1500 * {scale}) FROM f),
l AS (SELECT r, g, list(p ORDER BY o) AS ps FROM a GROUP BY r, g),
y AS (SELECT r, g, list_sum(list_transform(range(8), lambda h: greatest(list_reduce(list_prepend(CAST((h - 3) * {100 * scale} AS BIGINT), list_transform(ps, lambda p: CAST(p[h + 1] AS BIGINT))), lambda a, b: {add}), 0) * (h * 5 % 7 - 3))) + {b2} AS y FROM l),
z AS (SELECT item_id, g, CAST(greatest(least(y, 2147483647), -2147483648) AS BIGINT) AS s FROM y JOIN t USING (r))
SELECT item_id, count(*) AS gaps, count(*) FILTER (s > 0) AS cuts, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * (g % 5 + 1)) AS BIGINT) AS weighted FROM z GROUP BY item_id"""


QUERIES = {f.__name__: f for f in (train_step, adam_step, train_evaluation, diffusion_step, diffusion_state, word_clusters, break_round_trip, cluster_labels, order_treebank, character_references, cluster_network_exact, cluster_network_clamped)}
ORACLE_SQL = {
    "train_step": _step_sql("backpropagation", "true", f"SELECT '' AS model, {_ROW}, round(v - 5 * d, 6) AS value FROM n UNION ALL SELECT '', {_ROW}, round(d, 6) FROM d WHERE name = 'loss'"),
    "adam_step": _step_sql("backpropagation", "turn = 0", f"SELECT '' AS model, {_ROW}, round(v * (CASE WHEN name IN ('w1', 'wdict', 'w2') THEN 0.995e0 ELSE 1 END) - CASE WHEN seen THEN 0.01e0 * d / (sqrt(d * d) + 1e-8) ELSE 0 END, 6) AS value FROM n"),
    "train_evaluation": _step_sql("backpropagation", "true", ", k AS (SELECT count(*) FILTER (label = 1 AND y > 0) AS tp, count(*) FILTER (label = 0 AND y > 0) AS fp, count(*) FILTER (label = 1 AND y <= 0) AS fn, count(*) FILTER (label = 0 AND y <= 0) AS tn FROM er) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM k"),
    "diffusion_step": " UNION ALL ".join(f"SELECT * FROM ({_step_sql(rule, 'true', f', {_MOVED} SELECT ' + repr(rule) + f' AS model, {_ROW}, round(u, 6) AS value FROM z')})" for rule in ("hybrid", "pure")),
    "diffusion_state": _step_sql("hybrid", "true", f", {_MOVED} SELECT 'hybrid' AS model, (SELECT count(*) FROM z WHERE name = 'w2' AND u = 0) AS pinned, round(sqrt((SELECT sum((f.u - w.u) ** 2) FROM z f JOIN z w ON f.name = 'feedback' AND w.name = 'w2' AND f.i = w.i)) / sqrt((SELECT sum(u * u) FROM z WHERE name = 'w2')), 6) AS gap"),
    "word_clusters": f"WITH {_WORDS} SELECT word, array_to_string({_PARTS}, '|') AS clusters, CAST(length_grapheme(word) AS BIGINT) AS n FROM w",
    "break_round_trip": f"WITH {_WORDS} SELECT word, CAST(length_grapheme(word) AS BIGINT) AS n, array_to_string(list_transform({_PARTS}, lambda c: CAST(length(c) AS VARCHAR)), ',') AS sizes FROM w",
    "cluster_network_exact": _network_sql(False),
    "cluster_network_clamped": _network_sql(True),
    "order_treebank": "WITH t AS (SELECT l_returnflag AS path, l_orderkey AS o, string_agg(t, ' ' ORDER BY l_linenumber, t) AS line FROM (SELECT *, 'p' || l_partkey || '/' || l_suppkey || '/P' || l_partkey AS t FROM lineitem) GROUP BY ALL) SELECT path, row_number() OVER (PARTITION BY path ORDER BY o) - 1 AS sentence, line FROM t",
    "character_references": f"WITH {_LINES} SELECT doc_id, line_no, text FROM l",
    "cluster_labels": f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM l), m AS (SELECT doc_id, line_no, list_transform(w, lambda x: replace(CASE WHEN starts_with(x, 'e') THEN '́' || x ELSE x END, 'o', 'ö')) AS w FROM s WHERE len(w) > 0),
k AS (SELECT doc_id, line_no, len(w) AS words, array_to_string(w, '') AS t, len(list_filter(w[2:], lambda x: starts_with(x, '́'))) > 0 AS conflict, list_sum(list_transform(w, lambda x: length(regexp_replace(x[:-2], '[^u]', '', 'g')))) AS u FROM m)
SELECT doc_id, line_no, CASE WHEN conflict THEN 'conflict' ELSE 'example' END AS status, CAST(CASE WHEN conflict THEN 0 ELSE length_grapheme(t) - 1 - u END AS BIGINT) AS examples, CAST(CASE WHEN conflict THEN 0 ELSE words - 1 END AS BIGINT) AS bound, CAST(CASE WHEN conflict THEN 0 ELSE u END AS BIGINT) AS unknown, CAST(length(t) - length_grapheme(t) AS BIGINT) AS inside FROM k""",
}

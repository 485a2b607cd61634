"""The segmentation dataflow as joins, groupings and windows: every step is a table that SQL can check.

The Arrow scorers do the same work without a shuffle and are what ``Segmenter`` runs; these forms explain a result and
serve models that are tables themselves. Windows and groups are keyed by line, so none is larger than a line.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kireme.functions.arrays import let, running_sums
from kireme.functions.graphemes import WIDTHS, cluster_sizes, cluster_texts
from kireme.functions.text import chars, normalize, type_letters
from kireme.sources.models import LinearModel, NeuralModel

KEYS = ("doc_id", "line_no")
#: Patterns of a model that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A side of known size, broadcast if it is small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and text of every line of a document; null texts have none."""
    return docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def byte_offsets(line_rows: DataFrame) -> DataFrame:
    """Keys, pos, ch, byte_start and byte_end of each character in its line. Sums run along the line's array; nothing is shuffled."""
    runs = line_rows.filter("text <> ''").select(*KEYS, F.regexp_extract_all("text", F.lit(WIDTHS), F.lit(0)).alias("_r"))
    before = lambda size: F.concat(F.array(F.lit(0).cast("long")), running_sums(F.transform("_r", lambda r: size(r).cast("long"))))
    # all characters of a run have the same size, so sums are made over runs
    placed = runs.select(*KEYS, F.inline(F.zip_with(F.arrays_zip(F.col("_r").alias("r"), F.slice(before(F.char_length), F.lit(1), F.size("_r")).alias("p")), before(F.octet_length), lambda x, b: F.struct(x["r"].alias("_run"), x["p"].alias("_p"), b.alias("_b")))))
    placed = placed.filter("_run IS NOT NULL").withColumn("_w", (F.octet_length("_run") / F.char_length("_run")).cast("long"))
    rows = placed.select(*KEYS, "_p", "_b", "_w", F.posexplode(F.split("_run", "")).alias("_i", "ch"))
    start = F.col("_b") + F.col("_i") * F.col("_w")
    return rows.select(*KEYS, (F.col("_p") + F.col("_i")).cast("int").alias("pos"), "ch", start.alias("byte_start"), (start + F.col("_w")).alias("byte_end"))


def type_runs(line_rows: DataFrame) -> DataFrame:
    """Runs of equal character types: keys, run, type, first position and length, from each line's type letters. Nothing is shuffled."""
    runs = line_rows.filter("text <> ''").select(*KEYS, F.regexp_extract_all(type_string(F.col("text")), F.lit(r"(.)\1*+"), F.lit(0)).alias("_r"))
    sizes = F.transform("_r", lambda r: F.char_length(r).cast("long"))
    rows = runs.select(*KEYS, F.posexplode(F.arrays_zip(F.col("_r").alias("r"), running_sums(sizes).alias("e"))).alias("run", "_x"))
    n = F.char_length("_x.r").cast("long")
    return rows.select(*KEYS, F.col("run").cast("long").alias("run"), F.substring("_x.r", 1, 1).alias("type"), (F.col("_x.e") - n).alias("first_pos"), n.alias("n"))


def char_id_table(spark: SparkSession, char_map: str) -> DataFrame:
    """cp and char_id: ids from 1 in the order of first occurrence. The map is a model's, so it is small."""
    rows = spark.createDataFrame([(char_map,)], "m string").select(F.posexplode(chars(F.col("m"))).alias("pos", "ch"))
    firsts = rows.groupBy("ch").agg(F.min("pos").alias("pos"))
    return firsts.select(F.ascii("ch").alias("cp"), F.row_number().over(Window.orderBy("pos")).alias("char_id"))


def with_char_ids(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Ids of normalized characters, 0 where the table has none."""
    return rows.join(F.broadcast(table.select(F.col("cp").alias("_cp"), "char_id")), F.ascii("norm") == F.col("_cp"), "left").drop("_cp").withColumn("char_id", F.coalesce("char_id", F.lit(0)))


def vocabulary(line_rows: DataFrame, min_count: int = 2) -> DataFrame:
    """cp, n and row (from 2, by code point) of normalized characters seen ``min_count`` times."""
    counted = line_rows.select(F.explode(chars(normalize(F.col("text")))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    # one row per code point of Unicode at most
    return counted.select(F.ascii("ch").alias("cp"), "n", (F.row_number().over(Window.orderBy(F.ascii("ch"))) + 1).cast("long").alias("row"))


def ngrams(line_rows: DataFrame, longest: int, source: str = "norm") -> DataFrame:
    """Keys, length of the line, start, len and gram of all n-grams up to ``longest`` of the normalized characters (or of their type letters).

    The characters of a line are split once and neighbours put together, so a line costs its length; nothing is shuffled.
    """
    text = normalize(F.col("text")) if source == "norm" else type_string(F.col("text"))
    split = line_rows.filter("text <> ''").select(*KEYS, F.split(text, "").alias("_c"))
    # the array stays by reference beside each of its characters
    places = split.select(*KEYS, "_c", F.size("_c").alias("n_chars"), F.posexplode("_c").alias("start", "_g1"))
    for k in range(2, longest + 1):
        places = places.withColumn(f"_g{k}", F.concat(F.col(f"_g{k - 1}"), F.get("_c", F.col("start") + (k - 1))))
    grams = F.array(*[F.struct(F.lit(k).alias("len"), F.col(f"_g{k}").alias("gram")) for k in range(1, longest + 1)])
    return places.select(*KEYS, "n_chars", "start", F.inline(grams)).filter("gram IS NOT NULL")


def ngram_counts(line_rows: DataFrame, longest: int, source: str = "norm") -> DataFrame:
    """``gram`` and ``n``, how often each n-gram up to ``longest`` occurs.

    The longest gram at each place is counted first; shorter ones are its beginnings, and come from the distinct ones.
    """
    text = normalize(F.col("text")) if source == "norm" else type_string(F.col("text"))
    split = line_rows.filter("text <> ''").select(F.split(text, "").alias("_c"))
    places = split.select("_c", F.explode(F.sequence(F.lit(0), F.size("_c") - 1)).alias("_p"))
    # beyond the line's end there is nothing to add
    whole = places.select(F.concat(*[F.coalesce(F.get("_c", F.col("_p") + k), F.lit("")) for k in range(longest)]).alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    return whole.select("_n", F.explode(F.sequence(F.lit(1), F.char_length("_g"))).alias("_k"), "_g").select(F.expr("substring(_g, 1, _k)").alias("gram"), "_n").groupBy("gram").agg(F.sum("_n").alias("n"))


def type_string(text: Column) -> Column:
    return type_letters(text)


def boundaries(line_rows: DataFrame) -> DataFrame:
    """Keys and boundary (0 to length - 2) of every gap."""
    n = F.char_length("text")
    return line_rows.filter(n > 1).select(*KEYS, F.explode(F.sequence(F.lit(0), n - 2)).alias("boundary"))


def ngram_scores(line_rows: DataFrame, patterns: dict, window: int, source: str = "norm") -> DataFrame:
    """Keys, boundary and weight of each pattern match and place around it; the caller sums."""
    spark = line_rows.sparkSession
    schema = "gram string, vec array<int>"
    table = spark.createDataFrame([(g, [int(x) for x in v]) for g, v in patterns.items()], schema)
    longest = max(map(len, patterns), default=1)
    hits = ngrams(line_rows, longest, source).join(small(table, len(patterns)), "gram").select(*KEYS, "n_chars", (F.col("start") + F.col("len") - 1).alias("end"), F.posexplode("vec").alias("j", "weight"))
    placed = hits.select(*KEYS, "n_chars", (F.col("end") - window + F.col("j")).alias("boundary"), "weight")
    return placed.filter("boundary >= 0 AND boundary < n_chars - 1").select(*KEYS, "boundary", F.col("weight").cast("long").alias("weight"))


#: Prefixes of a dictionary that may be broadcast (some 80 bytes each); with more, all n-grams are joined by a shuffle.
BROADCAST_PREFIXES = 3_000_000
#: Units of a match that are walked prefix by prefix; longer words are joined from the places that are still open then.
WALKED = 24


def prefixes(words: DataFrame) -> DataFrame:
    """``gram`` and ``channels`` of every prefix of the words (word, channel); channels are null where the prefix is no word."""
    whole = words.filter("word <> ''").groupBy("word").agg(F.array_sort(F.collect_set("channel")).alias("_channels"))
    n = F.char_length("word")
    parts = whole.select("word", "_channels", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    return parts.select(F.expr("substring(word, 1, k)").alias("gram"), F.when(F.col("k") == n, F.col("_channels")).alias("channels")).groupBy("gram").agg(F.max("channels").alias("channels"))


def dictionary_hits(unit_rows: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """Keys, n_units, start, len (in units) and channel of each place where units spell a word.

    ``unit_rows`` has the keys and ``units``, the characters or clusters of a line; a match starts and ends with a unit. The
    walk goes on from a place only as long as what it has read begins a word: one join with the broadcast prefixes for
    each unit, all in one stage, and only matches leave it.
    """
    table = prefixes(words)
    places = unit_rows.select(*KEYS, F.size("units").alias("n_units"), F.col("units").alias("_u"), F.posexplode("units").alias("start", "_g"))
    following = F.slice("_u", F.col("start") + 1, F.lit(longest)).alias("_w")
    if table.count() > BROADCAST_PREFIXES:
        whole = words.select(F.col("word").alias("_word"), "channel").distinct()
        grams = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda k: F.struct(k.alias("len"), F.array_join(F.slice("_w", F.lit(1), k), "").alias("gram")))
        rows = places.select(*KEYS, "n_units", "start", following).select(*KEYS, "n_units", "start", F.inline(grams))
        return rows.join(whole, F.col("gram") == F.col("_word")).select(*KEYS, "n_units", "start", "len", "channel")
    side, found = F.broadcast(table), []
    for k in range(1, min(longest, WALKED) + 1):
        level = side.select(F.col("gram").alias("_p"), F.col("channels").alias(f"_c{k}"))
        if k == 1:
            # most places end here; the others go on with the units that a word could have, not with their whole line
            places = places.join(level, F.col("_g") == F.col("_p")).select(*KEYS, "n_units", "start", "_g", "_p", "_c1", following)
        else:
            places = places.join(level, F.col("_g") == F.col("_p"), "left")
        places = places.withColumn("_g", F.when(F.col("_p").isNotNull(), F.concat("_g", F.get("_w", F.lit(k))))).drop("_p")
        found.append(F.struct(F.lit(k).alias("len"), F.col(f"_c{k}").alias("channels")))
    if longest > WALKED:
        # few places are open so long
        rest = places.filter(F.col("_g").isNotNull()).select(*KEYS, "n_units", "start", "_w", F.explode(F.sequence(F.lit(WALKED + 1), F.size("_w"))).alias("len"))
        rest = rest.withColumn("_g", F.expr("array_join(slice(_w, 1, len), '')")).join(side.filter("channels IS NOT NULL"), F.col("_g") == F.col("gram"))
        rest = rest.select(*KEYS, "n_units", "start", "len", F.explode("channels").alias("channel"))
    hits = F.filter(F.array(*found), lambda x: x["channels"].isNotNull())
    walked = places.select(*KEYS, "n_units", "start", F.inline(hits)).select(*KEYS, "n_units", "start", "len", F.explode("channels").alias("channel"))
    return walked.unionByName(rest) if longest > WALKED else walked


def normalized_units(line_rows: DataFrame, clustered: bool = False) -> DataFrame:
    """Keys and ``units`` of each line: characters or clusters of the normalized text."""
    text = normalize(F.col("text"))
    return line_rows.filter("text <> ''").select(*KEYS, (cluster_texts(text) if clustered else F.split(text, "")).alias("units"))


def dictionary_features(line_rows: DataFrame, words: DataFrame, longest: int, max_label: int, clustered: bool = False) -> DataFrame:
    """Distinct (keys, boundary, channel, pos, label) of dictionary matches: pos 0 left of, 1 inside, 2 right of the word.

    ``words`` has word (normalized) and channel; ``label`` is the length less one, at most ``max_label`` - 1. With
    ``clustered`` units are clusters: matches start and end at them, and lengths and gaps count them.
    """
    hits = dictionary_hits(normalized_units(line_rows, clustered), words, longest).withColumn("label", F.least(F.col("len"), F.lit(max_label)) - 1)
    inside = F.when(F.col("len") > 1, F.transform(F.sequence(F.lit(0), F.col("len") - 2), lambda k: F.struct((F.col("start") + k).alias("boundary"), F.lit(1).alias("pos")))).otherwise(F.expr("cast(array() as array<struct<boundary:int,pos:int>>)"))
    places = F.concat(F.array(F.struct((F.col("start") - 1).alias("boundary"), F.lit(0).alias("pos"))), inside, F.array(F.struct((F.col("start") + F.col("len") - 1).alias("boundary"), F.lit(2).alias("pos"))))
    rows = hits.select(*KEYS, "n_units", "channel", "label", F.inline(places)).filter("boundary >= 0 AND boundary < n_units - 1")
    return rows.select(*KEYS, "boundary", "channel", "pos", "label").distinct()


def dictionary_scores(line_rows: DataFrame, m: LinearModel) -> DataFrame:
    """Keys, boundary and weight of each distinct dictionary feature; the caller sums."""
    words = line_rows.sparkSession.createDataFrame([(w, c) for w, bits in m.words.items() for c in range(8) if bits >> c & 1], "word string, channel int")
    weights = F.array(*[F.lit(int(x)).cast("long") for x in m.dict_vector])
    found = dictionary_features(line_rows, words, max(map(len, m.words)), m.dict_n)
    return found.select(*KEYS, "boundary", F.get(weights, F.col("channel") * 3 * m.dict_n + F.col("label") * 3 + F.col("pos")).alias("weight"))


def linear_scores(line_rows: DataFrame, m: LinearModel) -> DataFrame:
    """Keys, boundary and score under a linear model: bias, n-grams of characters and types, distinct dictionary features."""
    parts = boundaries(line_rows).select(*KEYS, "boundary", F.lit(m.bias).cast("long").alias("weight"))
    if m.char_patterns:
        parts = parts.unionByName(ngram_scores(line_rows, m.char_patterns, m.char_window))
    if m.type_patterns:
        parts = parts.unionByName(ngram_scores(line_rows, m.type_patterns, m.type_window, "type"))
    if m.words:
        parts = parts.unionByName(dictionary_scores(line_rows, m))
    return parts.groupBy(*KEYS, "boundary").agg(F.sum("weight").alias("score"))


def window_slots(line_rows: DataFrame, window: int, rows: str = "rows") -> DataFrame:
    """Keys, boundary, slot and row: the units around each gap (``rows`` has a line's units as an array), 0 beyond the line's ends.

    A gap takes its neighbours from the line's array; nothing is shuffled.
    """
    gaps = line_rows.filter(F.size(rows) > 1).select(*KEYS, F.col(rows).alias("_r"), F.explode(F.sequence(F.lit(0), F.size(rows) - 2)).alias("boundary"))
    slots = F.array(*[F.struct(F.lit(j).alias("slot"), F.coalesce(F.get("_r", F.col("boundary") + (j - window + 1)), F.lit(0)).alias("row")) for j in range(2 * window)])
    return gaps.select(*KEYS, "boundary", F.inline(slots))


#: Numbers of a table of parts that a plan may hold.
TABLED_NUMBERS = 500_000


def _constant(values, kind: str) -> Column:
    """A nested array as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def gap_lists(pairs: Column, n_gaps: Column) -> Column:
    """A list for each gap of the features that pairs (boundary, feature) name, ascending and without repeats."""
    marks = F.transform(F.sequence(F.lit(0), n_gaps - 1), lambda g: F.struct(g.alias("boundary"), F.lit(-1).alias("feature")))
    ordered = F.array_sort(F.array_distinct(F.concat(pairs, marks)))
    # a mark opens each gap's part; parts are cut there, so this costs a sort of the line's features
    listed = F.array_join(F.transform(ordered, lambda x: F.when(x["feature"] < 0, F.lit("|")).otherwise(F.concat(F.lit(","), x["feature"].cast("string")))), "")
    numbers = lambda part: F.transform(F.filter(F.split(part, ","), lambda f: f != ""), lambda f: f.cast("int"))
    return F.when(n_gaps > 0, F.transform(F.slice(F.split(listed, "[|]"), 2, F.greatest(n_gaps, F.lit(1))), numbers)).otherwise(F.expr("cast(array() as array<array<int>>)"))


#: Numbers that a gap's score may add up in one flat expression.
FLAT_NUMBERS = 96


def _flat_score(m: NeuralModel) -> Callable[[Callable[[int], Column]], Column] | None:
    """The exact score of a gap from the rows of the single characters around it, by slot, as one expression without
    inner arrays; None for networks that are too large for that or have dictionaries."""
    from kireme.functions.numeric import I32, clamp
    from kireme.operators.scoring import NeuralScorer

    h, slots, _ = m.w1.shape
    if any(m.dictionaries) or h * slots > FLAT_NUMBERS or len(m.emb) * slots * h > TABLED_NUMBERS:
        return None
    scorer = NeuralScorer(m, "int32")
    # parts by unit, slot and row
    parts = np.stack([scorer.block((r,), j) for j in range(slots) for r in range(len(m.emb))]).astype(int).T
    made = [[_constant(parts[k, j * len(m.emb) : (j + 1) * len(m.emb)].tolist(), "array<bigint>") for j in range(slots)] for k in range(h)]

    def score(row: Callable[[int], Column]) -> Column:
        y = F.lit(int(scorer.b2_q)).cast("long")
        for k in range(h):
            acc = F.lit(int(scorer.b1_q[k])).cast("long")
            for j in range(slots):
                acc = acc + F.get(made[k][j], row(j))
            y = y + F.greatest(acc, F.lit(0).cast("long")) * F.lit(int(m.w2[k])).cast("long")
        return clamp(y, *I32).cast("long")

    return score


def _row_of(unit: Column, m: NeuralModel) -> Column:
    """The embedding row of a single character: from 2 on those of the vocabulary in order, 1 is what it lacks, 0 what is beyond the line."""
    return F.coalesce(F.call_function("locate", unit, F.lit("".join(map(chr, m.vocabulary)))) + 1, F.lit(0))


def network_scores(units: Column, m: NeuralModel, precision: str = "int32", features: Column | None = None, single: bool = False) -> Column:
    """Scores of all gaps between units (characters or clusters, normalized) as an array, in the row. ``single`` tells that units are characters.

    A unit's part in a slot is the mean of its characters' vectors times the slot's weights, rounded to accumulator units;
    ``features`` are active dictionary features of each gap, ascending. ``int32`` sums are exact; ``int16`` folds parts of
    16 bits in slot order and then features, and clamps after each. The tensors are literals of the plan, so this form is for
    models of moderate size and for checks; ``operators.scoring`` runs large ones.
    """
    from kireme.functions.numeric import I16, I32, clamp, relu_dot, requant
    from kireme.operators.scoring import NeuralScorer

    if single and precision == "int32" and features is None and (flat := _flat_score(m)) is not None:
        return let(F.transform(units, lambda u: _row_of(u, m)), lambda rows: F.when(F.size(rows) > 1, F.transform(F.sequence(F.lit(0), F.size(rows) - 2), lambda g: flat(lambda j: F.coalesce(F.get(rows, g + (j - m.window + 1)), F.lit(0))))).otherwise(F.expr("cast(array() as array<bigint>)")))
    scorer, small_sums = NeuralScorer(m, precision), precision == "int16"
    h, slots, d = m.w1.shape
    vocabulary = "".join(map(chr, m.vocabulary))
    emb = _constant(m.emb.astype(int).tolist(), "array<array<bigint>>")
    w1 = _constant(m.w1.astype(int).transpose(1, 0, 2).reshape(slots * h, d).tolist(), "array<array<bigint>>")
    b1 = _constant((requant(scorer.b1_q) if small_sums else scorer.b1_q).astype(int).tolist(), "array<bigint>")
    w2 = _constant(m.w2.astype(int).tolist(), "array<bigint>")
    columns = None if scorer.dict_q is None else (requant(scorer.dict_q) if small_sums else scorer.dict_q).T
    wdict = None if columns is None else _constant(columns.astype(int).tolist(), "array<array<bigint>>")
    b2 = int((scorer.b2_q + 256) >> 9 if small_sums else scorer.b2_q)
    axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    zero = F.lit(0).cast("long")

    def pooled(rows: Column) -> Column:
        """How many characters a unit has, the first one's row, and the sum of their vectors."""
        return F.struct(F.size(rows).alias("n"), F.get(rows, F.lit(0)).alias("r"), F.transform(axis(d), lambda k: F.aggregate(rows, zero, lambda s, r: s + F.get(F.get(emb, r), k))).alias("v"))

    # parts of single characters are made beforehand, row by row and slot by slot, unless they are many
    made = None
    if len(m.emb) * slots * h <= TABLED_NUMBERS:
        blocks = np.stack([scorer.block((r,), j) for r in range(len(m.emb)) for j in range(slots)])
        made = _constant((requant(blocks) if small_sums else blocks).astype(int).tolist(), "array<array<bigint>>")

    def dot(u: Column, v: Column) -> Column:
        if d <= 8:
            return sum((F.get(u, F.lit(k)) * F.get(v, F.lit(k)) for k in range(1, d)), F.get(u, F.lit(0)) * F.get(v, F.lit(0)))
        return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), zero, lambda s, x: s + x)

    def part_in(j: int) -> Callable[[Column], Column]:
        def part(unit: Column) -> Column:
            def value(k: Column) -> Column:
                x = dot(F.get(w1, k + j * h), unit["v"]) * (F.lit(scorer.r) / unit["n"])
                whole = (F.sign(x) * F.floor(F.abs(x) + 0.5)).cast("long")
                return clamp(F.shiftright(whole + 256, 9), *I16) if small_sums else whole

            mixed = F.transform(axis(h), value)
            return mixed if made is None else F.when(unit["n"] == 1, F.get(made, unit["r"] * slots + j)).otherwise(mixed)

        return part

    pad = F.array(F.lit(0))
    # rows from 2 on are the vocabulary's characters in order, 1 is what it lacks
    encoded = lambda u: F.transform(F.split(u, ""), lambda c: F.call_function("locate", c, F.lit(vocabulary)) + 1)

    def scored(line: Column) -> Column:
        def gap(g: Column) -> Column:
            parts = F.array(*[let(F.coalesce(F.get(line["u"], g + (j - m.window + 1)), line["pad"]), part_in(j)) for j in range(slots)])
            if wdict is not None:
                parts = F.concat(parts, F.transform(F.coalesce(F.get(line["f"], g), F.expr("cast(array() as array<int>)")), lambda f: F.get(wdict, f)))
            add = (lambda x, y: clamp(x + y, *I16)) if small_sums else (lambda x, y: x + y)
            acc = F.aggregate(parts, b1, lambda s, p: F.zip_with(s, p, add))
            return clamp(relu_dot(acc, w2) + b2, *I32).cast("long")

        return F.transform(F.sequence(F.lit(0), F.size(line["u"]) - 2), gap)

    # what a gap reads is made once for its line
    lists = F.lit(None).cast("array<array<int>>") if features is None else features
    line = F.struct(F.transform(units, lambda u: pooled(encoded(u))).alias("u"), pooled(pad).alias("pad"), lists.alias("f"))
    return F.when(F.size(units) > 1, let(line, scored)).otherwise(F.expr("cast(array() as array<bigint>)"))


def network_lines(line_rows: DataFrame, m: NeuralModel, precision: str = "int32", clustered: bool = True) -> DataFrame:
    """Keys, units and scores (of the gaps between units) of each line under a network with its dictionaries.

    Keys must tell lines apart. Only dictionary matches are shuffled, and lines only to meet them; without dictionaries nothing is.
    """
    rows = normalized_units(line_rows, clustered)
    if not any(m.dictionaries):
        return rows.select(*KEYS, "units", network_scores(F.col("units"), m, precision).alias("scores"))
    listed = [(w, c) for c, ws in enumerate(m.dictionaries) for w in ws if w]
    words = line_rows.sparkSession.createDataFrame(listed, "word string, channel int").select(normalize(F.col("word")).alias("word"), "channel").distinct()
    found = dictionary_features(line_rows, words, max(len(w) for w, _ in listed), 4, clustered)
    pairs = found.groupBy(*KEYS).agg(F.collect_list(F.struct("boundary", (F.col("channel") * 12 + F.col("pos") * 4 + F.col("label")).alias("feature"))).alias("_f"))
    both = rows.join(pairs, list(KEYS), "left")
    lists = gap_lists(F.coalesce("_f", F.expr("cast(array() as array<struct<boundary:int,feature:int>>)")), F.size("units") - 1)
    return both.withColumn("_l", lists).select(*KEYS, "units", network_scores(F.col("units"), m, precision, F.col("_l")).alias("scores"))


def neural_scores(line_rows: DataFrame, m: NeuralModel) -> DataFrame:
    """Keys, boundary and the exact score of a network over characters (each a cluster of its own).

    Small networks score each gap in a row of its own, from its neighbours in the line's array, others all gaps in the line's row.
    """
    if (flat := _flat_score(m)) is not None:
        lines_ = line_rows.filter(F.char_length("text") > 1).select(*KEYS, F.split(normalize(F.col("text")), "").alias("_u"))
        gaps = lines_.select(*KEYS, "_u", F.explode(F.sequence(F.lit(0), F.size("_u") - 2)).alias("boundary"))
        near = [f"_r{j}" for j in range(2 * m.window)]
        rows = gaps.select(*KEYS, "boundary", *[_row_of(F.get("_u", F.col("boundary") + (j - m.window + 1)), m).alias(n) for j, n in enumerate(near)])
        return rows.select(*KEYS, "boundary", flat(lambda j: F.col(near[j])).alias("score"))
    return network_lines(line_rows, m, clustered=False).select(*KEYS, F.posexplode("scores").alias("boundary", "score"))


def words_from_cuts(line_rows: DataFrame, cuts: Column, units: Column | None = None) -> DataFrame:
    """Keys, word_idx, start, end (bytes) and surface of each line's words: its units (characters of ``text``, if not given) put together between cut gaps.

    ``cuts`` is an array of a boolean for each gap. Words are slices of the line's array; nothing is shuffled.
    """
    cut = line_rows.filter("text <> ''").select(*KEYS, (chars(F.col("text")) if units is None else units).alias("_u"), cuts.alias("_cut"))
    at = F.filter(F.sequence(F.lit(0), F.size("_cut")), lambda g: (g == 0) | F.coalesce(F.get("_cut", g - 1), F.lit(False)))
    words = let(at, lambda a: F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size("_u"))), lambda s, e: F.array_join(F.slice("_u", s + 1, e - s), "")))
    ends = lambda ws: running_sums(F.transform(ws, lambda w: F.octet_length(w).cast("long")))
    rows = cut.select(*KEYS, F.posexplode(let(words, lambda ws: F.arrays_zip(ws.alias("surface"), ends(ws).alias("end")))).alias("word_idx", "_x"))
    surface, end = F.col("_x.surface"), F.col("_x.end")
    return rows.select(*KEYS, F.col("word_idx").cast("long").alias("word_idx"), (end - F.octet_length(surface)).alias("start"), end.alias("end"), surface.alias("surface"))


def cluster_labels(sentences: DataFrame) -> DataFrame:
    """Status, labels and ``inside`` beside the other columns of annotated sentences (text, tags), without a shuffle.

    ``labels`` has a tag for each gap between clusters of the normalized text: 1, 0, or null where it is unknown.
    ``inside`` counts gaps inside clusters: their tags 0 and null say nothing, and a word boundary there makes the
    sentence a ``conflict``, which has no labels. Text that is no UTF-8 is ``invalid``, also without labels; sentences of
    one cluster are ``example`` and have none.
    """
    ends = F.when(F.is_valid_utf8("text"), running_sums(F.transform(cluster_sizes(normalize(F.try_validate_utf8("text"))), lambda n: n.cast("long"))))
    none = F.expr("cast(array() as array<tinyint>)")

    def judged(e: Column) -> Column:
        labels = F.transform(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), lambda x: F.get("tags", (x - 1).cast("int")))
        bound = lambda t: F.size(F.filter(t, lambda x: x == 1))
        inside = F.size("tags") - F.size(labels)
        status = F.when(bound(F.col("tags")) > bound(labels), "conflict").otherwise("example")
        return let(F.struct(status.alias("s"), labels.alias("l"), inside.alias("i")), lambda x: F.struct(x["s"].alias("status"), F.when(x["s"] == "example", x["l"]).otherwise(none).alias("labels"), x["i"].alias("inside")))

    invalid = F.struct(F.lit("invalid").alias("status"), none.alias("labels"), F.lit(0).alias("inside"))
    found = let(ends, lambda e: F.when(e.isNull(), invalid).otherwise(judged(e)))
    return sentences.select("*", F.inline(F.array(found)))


def channel_sets(words: DataFrame) -> DataFrame:
    """word (normalized) and its sorted channels; invalid and empty words are left out."""
    return words.filter(F.is_valid_utf8("word")).select(normalize(F.col("word")).alias("word"), "channel").filter("word <> ''").groupBy("word").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def extract_dictionary(words: DataFrame, min_count: int = 2, min_length: int = 1) -> DataFrame:
    """word and n of words seen often enough and long enough."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def boundary_metrics(gold: DataFrame, predicted: DataFrame, key: str = "line_no", line: str = "line") -> DataFrame:
    """Corpus precision, recall and F1 of word boundaries of two files of escaped lines, joined by line number.

    Precision is 1 where nothing is predicted, recall 1 where there is nothing to find.
    """
    from kireme.functions.text import boundary_offsets, unescape_words

    both = gold.select(key, unescape_words(F.col(line)).alias("g")).join(predicted.select(key, unescape_words(F.col(line)).alias("p")), key, "full")
    sets = both.select(boundary_offsets(F.coalesce("g", F.expr("cast(array() as array<string>)"))).alias("g"), boundary_offsets(F.coalesce("p", F.expr("cast(array() as array<string>)"))).alias("p"), F.assert_true(F.col("g").isNotNull() & F.col("p").isNotNull(), "the files have different lines").alias("_ok"))
    sums = sets.agg(F.sum(F.size(F.array_intersect("g", "p"))).alias("hit"), F.sum(F.size("g")).alias("gold"), F.sum(F.size("p")).alias("pred"), F.count(F.lit(1)).alias("sentences"), F.count("_ok").alias("_ok"))
    p = F.when(F.col("pred") > 0, F.col("hit") / F.col("pred")).otherwise(1.0)
    r = F.when(F.col("gold") > 0, F.col("hit") / F.col("gold")).otherwise(1.0)
    return sums.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.coalesce("gold", F.lit(0)).cast("long").alias("gold_boundaries"), "sentences")


def confusion_metrics(rows: DataFrame, label: str = "label", cut: str = "cut", times: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy of decisions; the ratios are 0 without a true positive.

    With ``times`` a row stands for so many equal decisions.
    """
    y, c = F.col(label).cast("int") == 1, F.col(cut)
    count = lambda test: F.count_if(test) if times is None else F.coalesce(F.sum(F.when(test, F.col(times))), F.lit(0)).cast("long")
    sums = rows.agg(count(y & c).alias("tp"), count(~y & c).alias("fp"), count(y & ~c).alias("fn"), count(~y & ~c).alias("tn"))
    tp = F.col("tp")
    p, r = tp / (tp + F.col("fp")), tp / (tp + F.col("fn"))
    ok = tp > 0
    n = tp + F.col("fp") + F.col("fn") + F.col("tn")
    return sums.select("*", F.when(ok, p).otherwise(0.0).alias("precision"), F.when(ok, r).otherwise(0.0).alias("recall"), F.when(ok, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.when(n > 0, (tp + F.col("tn")) / n).otherwise(0.0).alias("accuracy"))


def differing_lines(a: DataFrame, b: DataFrame, key: str = "line_no", line: str = "line") -> DataFrame:
    """Lines of two results and how many differ (a line that one lacks differs)."""
    j = a.select(key, F.col(line).alias("_a")).join(b.select(key, F.col(line).alias("_b")), key, "full")
    return j.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"))

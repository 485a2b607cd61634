import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kireme.errors import MalformedCorpus, MalformedModel, UnsupportedModelFormat
from kireme.sources import corpus as C
from kireme.sources import models as M


def parsed(spark, line, kind="full"):
    row = spark.createDataFrame([(line,)], "l string").select(C.parse_annotated(F.col("l"), kind).alias("p")).first().p
    return row.error if row.error else None if row.text is None else (row.text, row.tags)


def test_full_annotation(spark):
    assert parsed(spark, "コーパス/ko:pasu の/no 文/buN で/de す/su 。/.") == ("コーパスの文です。", [0, 0, 0, 1, 1, 1, 1, 1])
    text, tags = parsed(spark, "Hello\\ World 2024\\/12 a&b")
    assert text == "Hello World2024/12a&b" and len(tags) == 20 and [i for i, t in enumerate(tags) if t] == [10, 17]
    assert parsed(spark, "あ  い") == ("あい", [1]) and parsed(spark, "  ") is None and parsed(spark, None) is None
    assert parsed(spark, "あ\\").startswith(MalformedCorpus.code) and parsed(spark, "あ\\\\") == ("あ\\", [0])
    assert parsed(spark, "/x y\r") == ("y", []) and parsed(spark, "a/b/c\\ d e") == ("ae", [1])
    assert len(parsed(spark, "あ" * 100_000 + "\\ " * 50_000)[0]) == 150_000


def test_partial_annotation(spark):
    assert parsed(spark, "み-ず/water|を?た", "partial") == ("みずをた", [0, 1, None])
    assert parsed(spark, "あ|い|", "partial") == ("あい", [1]) and parsed(spark, "あ|\\--い", "partial") == ("あ-い", [1, 0])
    assert parsed(spark, "あ り ま", "partial") == ("ありま", [None, None]) and parsed(spark, "", "partial") is None
    for bad in ("あい", "|あ", "あ||い", "あ-\\", "/x"):
        assert parsed(spark, bad, "partial").startswith(MalformedCorpus.code)


def test_annotated_frames(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes("あ い\r\n\n あ\\\n".encode())
    rows = C.read_annotated(spark, str(tmp_path), strict=False).collect()
    assert [(r.text, r.tags, bool(r.error)) for r in rows] == [("あい", [1], False), (None, None, True)]
    with pytest.raises(Exception, match="MalformedCorpus"):
        C.read_annotated(spark, str(tmp_path)).collect()
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\n")
    assert C.read_annotated(spark, str(tmp_path), strict=False).first().error == "InvalidUtf8"


def test_lines_and_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x y\r\n\nz\tq\n")
    assert [r.text for r in C.read_lines(spark, str(tmp_path)).collect()] == ["x y\r", "", "z\tq"]
    assert [(r.line_no, r.text) for r in C.read_numbered_lines(spark, str(tmp_path)).sort("line_no").collect()] == [(1, "x y\r"), (2, ""), (3, "z\tq")]
    assert [r.word for r in C.read_dictionary(spark, str(tmp_path)).collect()] == ["x", "z"]
    lists = C.stack_dictionaries([spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("b",)], "word string")])
    assert sorted(map(tuple, lists.collect())) == [(0, "a"), (1, "b")]


def test_treebank_lexicon_html_ucd(spark):
    t = lambda *f: "\t".join(f)
    body = ["# x", t("1", "私", "_", "PRON", "代", "_", "0", "_", "_", "UnidicInfo=ワタシ,x"), t("2-3", *["_"] * 9), t("2", "a/b", "_", "_", "助", "_", "0", "_", "_", "_"), "", t("1", "猫", "_", "_", "名", "_", "0", "_", "_", "A=b|UnidicInfo=ネコ")]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(body)], "path string, line_no long, text string")
    assert [r.line for r in C.conllu_sentences(lines).sort("sentence").collect()] == ["私/代/ワタシ a\\/b/助/", "猫/名/ネコ"]
    lex = spark.createDataFrame([("東京",), ("東京",), ("x",), ("�ab",)], "_c0 string")
    assert sorted(r.word for r in C.lexicon_words(lex).collect()) == ["ab", "東京"]
    html = '<p>skip</p><div class="main_text">私<ruby>は<rp>(</rp><rt>ha</rt></ruby>。［＃注］次！<br />　終&amp;</div><div class="bibliographical_information">x'
    assert spark.createDataFrame([(html,)], "h string").select(C.clean_ruby_html(F.col("h"))).first()[0] == ["私は。", "次！", "終&"]
    ucd = spark.createDataFrame([("0041..005A ; Letter # x",), ("# c",), ("00AD  ; Fmt",)], "text string")
    assert sorted(map(tuple, C.ucd_ranges(ucd).collect())) == [(65, 90, "Letter"), (173, 173, "Fmt")]


def automaton(patterns: dict) -> bytes:
    """Bytes of an automaton of id sequences, with the payload bytes of each."""
    if not patterns:
        return b"\0" + struct.pack("<I", 0)
    states, entries = [{}], list(patterns)
    ends = {}
    for p in entries:
        s = 0
        for c in p:
            if c not in states[s]:
                states.append({})
                states[s][c] = len(states) - 1
            s = states[s][c]
        ends[s] = entries.index(p)
    out = b"\1" + struct.pack("<I", len(states))
    for i, s in enumerate(states):
        out += struct.pack("<II", 0, len(s)) + b"".join(struct.pack("<HI", c, s[c]) for c in sorted(s))
        out += struct.pack("<I", 1) + struct.pack("<I", ends[i]) + b"\1" if i in ends else struct.pack("<I", 0) + b"\0"
    return out + struct.pack("<I", len(entries)) + b"".join(patterns[p] for p in entries)


def weights(*v: int) -> bytes:
    return struct.pack(f"<I{len(v)}h", len(v), *v)


def linear_file(chars=None, types=None, words=None, dict_vector=(), bias=-7) -> bytes:
    out = b"KyTea 0.4.0 B utf8\n" + b"\1\0" + struct.pack("<I5B", 0, 3, 3, 3, 3, 4) + b"\1" + struct.pack("<d", 0.1) + b"\1"
    out += "KTHRDOあい本".encode() + b"\0" + struct.pack("<iBii", 2, 1, 1, -1) + b"\1" + struct.pack("<d", 0.25) + b"\1"
    out += automaton(chars or {}) + automaton(types or {}) + automaton({}) + weights(*dict_vector) + weights(bias) + weights() + weights()
    return out + automaton(words or {}) + automaton({})


def test_linear_file():
    word = lambda ids: struct.pack(f"<I{len(ids)}H", len(ids), *ids) + b"\1"
    m = M.parse_linear(linear_file({(7,): weights(1, 2, 3, 4, 5, 6), (7, 8): weights(*[9] * 6)}, {(3,): weights(*[1] * 6)}, {(7, 8): word((7, 8))}, range(1, 13)))
    assert set(m.char_patterns) == {"あ", "あい"} and set(m.type_patterns) == {"H"} and m.words == {"あい": 1}
    assert m.bias == -7 and m.multiplier == 0.25 and M.char_ids("KTKO")["O"] == 3
    with pytest.raises(UnsupportedModelFormat):
        M.parse_linear(b"KyTea 0.3.0 B utf8\n")
    with pytest.raises(MalformedModel):
        M.parse_linear(linear_file()[:-4])
    with pytest.raises(MalformedModel):
        M.parse_linear(linear_file({(7,): weights(1, 2)}))


def tiny(dictionaries=True) -> M.NeuralModel:
    wdict = np.zeros((1, 12), np.int16)
    wdict[0, 5] = 10
    return M.NeuralModel(2, [0x3042], np.array([[7], [-50], [100]], np.int16), np.array([[[3], [-2], [4], [-5]]], np.int16), np.array([0.5]), np.array([5], np.int16), -1.0, 0.01, 0.1, 1.0, 0.001, wdict if dictionaries else None, 0.002, [["ああ"]] if dictionaries else [])


def test_neural_file(spark, tmp_path):
    raw = M.serialize_neural(tiny())
    assert M.serialize_neural(M.load_model(raw)) == raw
    for bad in (raw[:-1], raw + b"\0"):
        with pytest.raises(MalformedModel):
            M.parse_neural(bad)
    with pytest.raises(UnsupportedModelFormat):
        M.parse_neural(raw, "ed")
    M.register_signature("mlp", "Other 1")
    foreign = raw.replace(b"KiremeMLP 1", b"Other 1", 1)
    with pytest.raises(UnsupportedModelFormat):
        M.parse_neural(foreign)
    assert M.parse_neural(foreign, dictionaries=[["ああ"]]).dictionaries == [["ああ"]]
    (tmp_path / "m.mod").write_bytes(raw)
    assert M.read_bytes(spark, str(tmp_path / "m.mod")) == raw
    assert M.tensor_table(spark, tiny()).count() == 3 + 4 + 1 + 1 + 12


def test_numbered_lines_of_one_file_in_many_splits(spark, tmp_path):
    import random

    rng = random.Random(1)
    lines = ["x" * rng.randrange(0, 60) + f" {i}" if rng.random() < 0.9 else "" for i in range(4000)]
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    (tmp_path / "one/a.txt").write_text("\n".join(lines))
    (tmp_path / "one/b.txt").write_text("only\r\n")
    (tmp_path / "one/empty.txt").write_text("")
    for k in range(8):
        (tmp_path / f"many/{k}.txt").write_text("\n".join(lines[k * 500 : k * 500 + 500]) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = C.read_numbered_lines(spark, str(tmp_path / "one"))
        assert found.rdd.getNumPartitions() > 10
        rows = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.text) for r in found.collect())
        assert rows == [("a.txt", i + 1, x) for i, x in enumerate(lines)] + [("b.txt", 1, "only\r")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "BroadcastHashJoin" in plan
        pieces = C.read_numbered_lines(spark, str(tmp_path / "many")).collect()
        assert sorted((int(r.path[-5]) * 500 + r.line_no, r.text) for r in pieces) == [(i + 1, x) for i, x in enumerate(lines)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sentences_cross_chunks(spark, monkeypatch):
    row = lambda i, w: "\t".join([str(i), w, "_", "_", "N", *"____", "_"])
    texts = ["", "# c", row(1, "a"), row(2, "b"), "x", row(3, "c"), "", "", row(1, "d"), "1-2\t_", row(2, "e"), " \r", row(1, "f")]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)] + [("q", 10 * i, t) for i, t in enumerate(texts)] + [("n", 0, None)], "path string, line_no long, text string")
    want = [(0 + 1, "a/N/ b/N/ c/N/"), (3, "d/N/ e/N/"), (4, "f/N/")]
    for chunk in (1, 3, 1 << 16):
        monkeypatch.setattr(C.segmented_counts, "__defaults__", ("path", "line_no", chunk))
        assert sorted((r.path, r.sentence, r.line) for r in C.conllu_sentences(lines).collect()) == [(p, s, w) for p in "pq" for s, w in want]


def test_character_references(spark):
    from html import unescape

    from kireme.functions.references import unescape_references

    texts = ["a&hellip;b &#8212; c &eacute;", "&amp;lt; &lt &ltx &notit; &notin; &NotEqualTilde;", "&#0; &#x80; &#129; &#xD800; &#x110000; &#99999999999; &#x1F468; &#1; &#xFFFE; &#65 &#x41z", "& &; &&amp; &#; &#x; &unknown; &ampamp; &Eacuteé", "&" * 50 + "amp;", "none", "", None, "&#00065; &#x00041;", "&CounterClockwiseContourIntegral;&x" + "y" * 60]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape_references(F.col("t")).alias("u")).collect()
    for r in found:
        assert r.u == (None if r.t is None else unescape(r.t)), r.t

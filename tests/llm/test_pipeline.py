"""The pipeline against brute-force versions of its stages on a small table."""

import re

import pytest

import corpus_pipeline as P
from kireme.llm import quality
from tests.llm.test_text_operators import brute_components, check_packing, hits, pieces_of, spans_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark, stages):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [df for _, df in stages]
    for df in tables[:-1]:
        assert tuple(df.columns) == P.COLUMNS
    kept = {r.doc_id for r in quality.quality_report(source).filter("kept").collect()}
    first = texts(tables[0])
    assert set(first) == kept and all(first[k] == t for k, t in texts(source).items() if k in kept)

    from kireme.llm.simhash import fingerprint

    ids = sorted(first)
    roots = brute_components([fingerprint(first[i].encode()) for i in ids])
    assert set(texts(tables[1])) == {ids[r] for r in roots}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    second = texts(tables[1])
    n_hit = {i: hits(t, items)[1] for i, t in second.items()}
    third = texts(tables[2])
    assert set(third) == {i for i, n in n_hit.items() if n < 10}
    assert all(third[i] == second[i] for i in third if n_hit[i] == 0)

    fourth = texts(tables[3])
    assert set(fourth) == set(third)
    for i, t in fourth.items():
        assert not spans_of(t)
        if not spans_of(third[i]) and not re.search("[0-9]", third[i]):
            assert t == third[i]
    check_packing(tables[4].collect(), pieces_of(fourth.items()))


def test_stages_on_awkward_rows(spark, awkward):
    docs = awkward.select(*P.COLUMNS)
    for _, stage in P.STAGES:
        for table in (docs, docs.limit(0)):
            assert stage(spark, table, SF).count() >= 0
    assert P.redact(spark, docs, SF).count() == docs.count()


def test_run(spark, stages):
    assert P.run(spark, SF).count() == stages[-1][1].count()


def test_redaction_of_long_secrets(spark, docs):
    """Secrets of any length go whole, bare and after a key word."""
    long = "a1B2c3D4" * 625
    got = {r.doc_id: r.text for r in P.redact(spark, docs(f"see {long} there", f"x token={long}/+.{long} y").select(*P.COLUMNS), SF).collect()}
    assert got == {0: "see [SECRET] there", 1: "x [SECRET] y"}


def test_near_duplicates_without_good_ids(spark, docs):
    """Null ids and ids that repeat lose no text and spare no copy."""
    a, b, c = ("one two three four five six", "quite another text stands in here", "and a third text of its own words")
    rows = docs((None, a), (None, b), (None, b), (5, c), (5, c), (5, "yet one more text under an id that repeats"), (None, c))
    got = sorted((r.doc_id or 0, r.text) for r in P.near_duplicates(spark, rows.select(*P.COLUMNS), SF).collect())
    assert got == sorted([(0, a), (0, b), (5, c), (5, "yet one more text under an id that repeats")])


@pytest.fixture
def short_items(spark, tmp_path):
    items = [(1, "forty two"), (2, "one two three four five six seven eight nine ten eleven")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_decontamination_without_good_ids(spark, docs, short_items):
    """Each row is judged by its own text."""
    leak = "so one two three four five six seven eight nine ten it is"
    rows = docs((None, leak), (None, "clean"), (5, leak), (5, "clean too"), (5, "is forty two here"), (6, None))
    got = [(r.doc_id, r.text) for r in P.decontaminate(spark, rows.select(*P.COLUMNS), short_items).collect()]
    assert got == [(None, "clean"), (5, "clean too"), (5, "is   here"), (6, None)]


def test_scattered_short_items_are_only_cut_out(spark, docs, short_items):
    text = "word forty two other " * 30
    got = P.decontaminate(spark, docs(text, "forty two " * 9).select(*P.COLUMNS), short_items).collect()
    assert [r.text.split() for r in got] == [["word", "other"] * 30, []] and got[0].n_chars == len(got[0].text)

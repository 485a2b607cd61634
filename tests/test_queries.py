import pytest

from kireme import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "line_no", "word_idx", "start", "end", "surface"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_cut_inside_a_reference(spark, tmp_path):
    pages = [(1, "a&amp<p>b&amp;c"), (2, "x &lt"), (3, "&#39;&#39 &copy&nbsp;&quot;z. R&am"), (4, "&amp;lt; &ampx; &middot;&middot"), (5, None)]
    spark.createDataFrame(pages, "page_id long, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    same(spark, queries.html_clean_lines, queries.ORACLE_SQL["html_clean_lines"], str(tmp_path))

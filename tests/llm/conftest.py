import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from texts or (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(*texts):
        rows = [(*t, None, None, None) if isinstance(t, tuple) else (i, t, "en", "s", None) for i, t in enumerate(texts)]
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("n_words", F.lit("y")).withColumn("length", F.lit(0)).withColumn("spans", F.lit(1)).withColumn("kept", F.lit(2))

    return make


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls, empty and blank texts, repeated rows, a null id, ties and a long text."""
    return docs((1, None), (2, ""), (3, " \n\t "), (4, "same words here in this row"), (4, "same words here in this row"), (None, "no id"), (7, "w " * 60000), (8, "été 日本 a@b.co 1.2.3.4"))

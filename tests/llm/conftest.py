import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that operators use themselves
    T.StructField("n", T.StringType()), T.StructField("row", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()), T.StructField("start", T.StringType()),
])


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table with extra columns of clashing names from (doc_id, text[, lang])."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "x", "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text and one without letters."""
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    return docs([
        (1000001, None, "en"), (1000002, "", None), (1000003, " \n\t ", "en"), (1000004, "plain words stand here", "en"), (1000004, "plain words stand here", "en"),
        (1000005, "plain words stand here", None), (None, "plain words stand here", "en"), (None, None, None), (1000006, long, "en"), (1000007, "123 456 !!", "de"),
        (1000008, "Ünïcödé ß   \x00 \U0001f600 text", "de"), (1000009, "9" * 50_000, None), (1000010, "x" * 60_000, "en"),
    ])

import pytest

# A word's worth of odd texts that every operator must take.
ODD = ["", None, "   \n\t ", "x", "é" * 700, "a b\n" * 300, "😀 emoji \u0000 nul", "word " * 3000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, long texts, repeated rows and extra columns with clashing names."""
    rows = [(i, t, "en", "s", i, i, "z") for i, t in enumerate(ODD)] + [(None, "null id " * 9, None, None, None, None, None)] * 2 + [(3, "x", "en", "s", 3, 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, doc string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

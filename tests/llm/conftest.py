import random

import pytest

#: id, text, lang: nulls, empty, repeated rows, ties, one very long text.
EDGE = [(1, None, None), (2, "", "en"), (3, "   \n\t", "en"), (4, "a", None), (5, "same text of five words", "en"), (6, "same  text of\nfive words", "en"), (6, "same  text of\nfive words", "en"), (None, "no id here at all", None), (7, "!!! ???", "de"), (8, "Ä é 中文 \U0001f600", "xx"), (9, "word " * 30_000, "en"), (10, "x" * 100_000, "en")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, a string, words string"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with awkward rows and columns named like the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", 0, 0.5, 3, "q", "w") for i, t, lang in EDGE], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@pytest.fixture
def rng():
    return random.Random(5)

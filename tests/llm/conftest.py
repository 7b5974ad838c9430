import pytest


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path


@pytest.fixture
def odd_rows(spark):
    """Nulls, empty and long texts, equal rows, ties, and columns whose names the operators use too."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, "a b c", "s", 1), (2, None, None, 1), (3, "", "s", None), (None, "a b c d e f g h i j k l m n", "t", 2), (5, long, None, 2), (5, long, None, 2), (6, long + " tail", "t", 3), (7, " \n\t ", "", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words int")


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, n_words int")

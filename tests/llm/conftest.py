import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, node long, uid long"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "one two"), (None, "one two"), (6, long), (7, long), (8, " x y <|endoftext|> z")]
    return spark.createDataFrame([(i, t, None, None, None, 0.5, 1, 1, 1) for i, t in rows], KIND)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], KIND)

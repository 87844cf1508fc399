import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Odd and ordinary rows, with extra columns that clash with names the operators use."""
    long = "lorem ipsum dolor sit amet " * 4000
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away into the dark wood", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away into the dark wood", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n ", "de", None),
        (6, long, "de", "a"),
        (7, "word", "fr", "c"),
        (None, "a row without an id", "fr", "c"),
        (8, "Ünïcödé wörds ΟΔΟΣ 漢字 ** ## <b>", "es", None),
        (8, "Ünïcödé wörds ΟΔΟΣ 漢字 ** ## <b>", "es", None),
    ]
    rows = [(*r, None, "x", 1) for r in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, m_size int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")

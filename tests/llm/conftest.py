import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, tokens string, leaks string, node string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash with results."""
    long = "wörd and other things, " * 30_000
    rows = [
        (1, None, None, None, None),
        (None, "some text without an id", "en", "a", 23),
        (2, "", "en", "b", 0),
        (3, " \n\t ", "de", None, 4),
        (4, long, "en", "c", len(long)),
        (5, "x" * 400_000, None, "d", 400_000),
        (6, "one two", "xx", "e", 7),
        (6, "one two", "xx", "e", 7),
        (7, "1." * 50_000 + "+" * 1000 + "1 " * 5000 + "@" * 1000, "fr", "f", 1),
    ]
    return spark.createDataFrame([(*r, "k", "s", "t", "l", "n") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

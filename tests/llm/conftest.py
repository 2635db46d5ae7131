import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, a further column with a clashing name."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0, "x"),
        (2, "", None, None, 0, "x"),
        (3, "   \n\t ", "en", "", None, None),
        (4, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 10, "x"),
        (4, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 10, "x"),
        (5, long, "en", "b", 10, "x"),
        (6, long, "de", "b", 10, "x"),
        (None, "A text without an id, a@b.example and nothing more.", None, "c", None, "x"),
        (7, "!!! ??? 123", "en", "c", 1, "x"),
        (8, "\u0000 \ud7ff 日本語のテキスト", "xx", "c", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)

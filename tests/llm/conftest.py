import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    prose = " ".join(f"word{i % 97} thing{i % 89}" for i in range(60))
    rows = [
        (1, prose, "en", "a", 10), (2, prose, "en", "b", 10), (3, prose + " end", "en", None, 10), (4, "", "en", "a", 0), (5, None, None, None, None),
        (None, prose, "en", "a", 10), (None, None, None, None, None), (6, " \t\n", "en", "c", 3), (7, "one two", "en", "c", 7), (8, "ONE  two", "en", "c", 8),
        (9, "x " * 40_000, "en", "a", 80_000), (10, "same line here\n" * 30, "en", "b", 450), (11, "Ünïcode ☃ 𝄞 " * 30, "de", "b", 300),
        (1, prose, "en", "a", 10), (1, prose, "en", "a", 10), (12, prose.upper(), "en", "b", 10),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

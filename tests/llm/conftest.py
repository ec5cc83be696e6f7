import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string, chunk int, size long, h long, fp long, content long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing columns."""
    long_text = " ".join(f"word{i % 977} lorem{i % 13}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \t\n ", "fr", "b", 4),
        (6, long_text, "es", "c", len(long_text)),
        (7, long_text + " tail", "es", "c", len(long_text) + 5),
        (None, "one two", "en", None, 7),
        (8, "ünï cödé 文字 😀 mail jane@example.com", None, "d", 3),
        (9, "x" * 50_000, "en", "d", 50_000),
    ]
    return spark.createDataFrame([r + (0.5, "b", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

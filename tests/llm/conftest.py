import pytest

from tests.conftest import sf, spark  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):  # noqa: F811
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long = "the quick brown fox jumps over a lazy dog " * 3000
    rows = [(1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, long, "en", "b", len(long)), (None, "words without an id at all", None, "a", 3),
            (5, "one two three four five six", "fr", "b", 27), (1, "one two three four five six", "en", "a", 27),
            (6, " \t\n", "en", "a", 3), (7, "x" * 50_000, "de", "c", 50_000), (8, "é ñ 日本 \U0001f600 <s> ▁▁ <|endoftext|>", "en", "a", 9),
            (9, "12345 !!! ???", "en", "a", 13), (1, "another text under one id", "en", "b", 25)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("size", "shard", "slot", "score", "node", "key", "part", "block", "weight", "host", "label", "count"):
        frame = frame.selectExpr("*", f"'clash' as {name}")
    return frame


@pytest.fixture(scope="session")
def no_documents(spark):  # noqa: F811
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):  # noqa: F811
    return spark.read.parquet(f"{sf}/documents.parquet")

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, TEXT string"

WEIRD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1, "x", 1, "clash"),
    (2, None, "en", "a", None, None, None, None),
    (3, "", None, None, 0, None, None, None),
    (4, " \t\n ", "en", "b", 4, None, None, None),
    (None, "no id here", "en", "b", 4, None, None, None),
    (5, "same row", "en", "c", 8, None, None, None),
    (5, "same row", "en", "c", 8, None, None, None),
    (6, "same row", "en", "c", 8, None, None, None),
    (7, "naïve 漢字 \x85 odd\xa0 spaces 😀 <|endoftext|> x", "en", "d", 8, None, None, None),
    (8, "word " * 30000, "en", "d", 150000, None, None, None),
    (9, "x" * 50000, "en", "e", 50000, None, None, None),
]


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(WEIRD, SCHEMA)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

import pytest

DIR = "/root/testdata/sf0.001"
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
#: Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own.
ROWS = [
    (1, LINE * 3 + "end", "en", "a", 10, "x", 1, "n"),
    (1, LINE * 3 + "end", "en", "a", 10, "x", 1, "n"),
    (2, LINE + "other words here", "en", "a", None, None, 2, "n"),
    (3, None, None, None, None, None, None, None),
    (4, "", "fr", "b", 0, "y", 4, "m"),
    (None, " \t\n", "fr", "b", 3, "y", 5, "m"),
    (None, "word", None, "b", 4, "y", 6, "m"),
    (5, "Word", "de", None, 4, "y", 7, "m"),
    (6, "w o\trd", "de", None, 5, "y", 8, "m"),
    (7, "ab" * 40_000, "en", "a", 80_000, "z", 9, "n"),
    (8, "é日😀\x1c\x85 ###</turn> \\h ▁ x" * 20, "es", "b", 400, "z", 10, "n"),
    (9, "x\n" * 400 + "tail", "en", "a", 804, "z", 11, "n"),
    (10, "you idiot", "en", "a", 9, "z", 12, "n"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc_key string, node long, copies string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="session")
def both(documents, odd):
    """The given documents and the odd rows, the latter under ids behind the former."""
    from pyspark.sql import functions as F

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return documents.select(columns).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1_000_000).select(columns)).cache()


@pytest.fixture(scope="session")
def rows(both):
    return both.collect()

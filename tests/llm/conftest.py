import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def _words(rng, n):
    parts = ["the", "an", "er", "on", "re", "ti", "sh", "ou", "ble", "ing", "nd", "ha"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    long = _words(rng, 60_000)
    some = _words(rng, 200)
    return [
        (1, some, "en", "a", 5), (1, some, "en", "a", 5), (2, some, "en", "b", 5), (3, "", "en", "a", 0), (4, None, "en", "a", None), (5, long, "en", None, 1),
        (6, "x" * 300_000, None, "", 1), (None, "one two three four five six", "en", "a", 1), (None, None, None, None, None), (7, " \n\t ", "de", "b", 3),
        (8, some.upper() + "!", "en", "b", 5), (9, "tie", "en", "c", 3), (10, "tie", "en", "c", 3), (11, "é漢字 😀 ▁ ﷽ <|endoftext|> a", "fr", "c", 3),
        (12, "Released under the MIT License.", "en", "d", 3),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """These rows with more columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA)
    names = ["node", "size", "key", "order", "bucket", "score", "stats", "row", "x", "k", "y", "class_id", "ids", "media", "predicted", "source_size", "token", "file", "slot", "words"]
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, None, 1), (None, 1, 1), (99, 0, 1), (5, 0, 0), (8, 1, 1)], LABELS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"

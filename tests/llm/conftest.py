import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(1)
    long_ = " ".join(words(rng, 60_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "one", "en", "b", 3),
        (4, "one", "en", "b", 3),
        (None, "one", None, None, None),
        (5, "The quick brown fox jumps over the lazy dog. Ünïcödé 日本 😀", "en", "b", 5),
        (6, long_, "en", "b", len(long_)),
        (7, long_, "en", None, len(long_)),
        (-8, "1234 ### !!!", None, "", 12),
        (9, "a\x00b\x1cc\x85d e", "de", "c", 9),
    ]
    rows += [(100 + i, " ".join(words(rng, 5 + i)), ("en", "de", "fr")[i % 3], f"s{i % 4}", i) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Columns whose names operators use inside.
CLASH = ["size", "draw", "bucket", "target", "copies", "fp", "key", "words", "ring", "least", "score", "s", "t", "w", "host", "path", "wrapper", "tokens", "part", "ghost", "id", "rn", "d", "kept", "component"]


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit("x").alias(c) for c in CLASH))

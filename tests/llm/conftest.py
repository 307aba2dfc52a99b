import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stem=""):
    return " ".join(stem + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def make(spark):
    def docs(rows, extra=""):
        return spark.createDataFrame(rows, SCHEMA + extra)

    return docs


@pytest.fixture
def odd_rows(rng):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    long = prose(rng, 30_000)
    a = prose(rng, 60)
    return [(1, a, "en", "s1", 1), (1, a, "en", "s1", 1), (2, a, None, "s2", None), (3, None, "en", "s1", None), (4, "", "fr", None, 0), (None, a, "en", "s1", 2),
            (5, long, "en", "s1", 3), (6, "   \n\t ", "fr", "s2", 4), (7, "12 34 !!", "fr", "s2", 5), (8, "one", "en", "s1", 3), (9, prose(rng, 40, "é"), "fr", "s2", 6), (None, None, None, None, None)]

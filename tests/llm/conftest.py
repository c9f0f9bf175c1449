import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def table(spark):
    """Makes a documents table of texts, or of whole rows."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (i, r, "en", f"s{i % 3}", len(r) if r else 0) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows, texts of few words."""
    rng = random.Random(5)
    long = words(rng, 40_000)
    same = words(rng, 60)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, same, "en", "a", 1), (None, None, None, "a", None), (3, same, None, "a", 1), (3, same, None, "a", 1), (4, same, "en", None, 1), (5, long, "en", "a", 1),
        (6, long + " end", "en", "b", 1), (7, "one two", "en", "b", 1), (8, "One, two!", "en", "b", 1), (9, " \n\t ", "en", "b", 1), (10, "%%% ###", "xx", "b", 1), (-1, "été çà  😀 \x1c x", "fr", "b", 1), (7, "another text of the same id", "fr", "c", 1),
    ]

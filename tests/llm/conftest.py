"""Fixtures of the corpus operators' tests."""

import pytest

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the very big bad wolf in the dark wood tonight", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "de", "b"),
    (5, "one", "de", "b"),
    (5, "one", "de", "b"),
    (None, "no id here", "fr", None),
    (6, "Ünïcode ßtraße — naïve café   x y " * 30, "de", "b"),
    (7, "long " * 40_000 + "end", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA)

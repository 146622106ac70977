"""Awkward rows that every operator has to stand."""

import pytest

LONG = "Lorem ipsum, dolor. " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns that clash with results."""
    rows = [
        (1, "one two three four", "a"), (1, "one two three four", "a"), (2, None, "a"), (3, "", None), (4, "   \n\t ", "b"),
        (None, "no id here", "b"), (None, None, None), (5, LONG, "c"), (6, LONG, "c"), (7, "One two three FOUR", "a"),
        (8, "ﬁne Ⅷ ünïcode \U0001F600 é", "b"), (9, "x", "b"), (10, "one two three four five six", "a"),
    ]
    fields = "doc_id long, text string, source string, fingerprint string, component_id string, score string, n_tokens string, size string, _copy int, _fp string, _row string, _mentions string, row string, _digest string"
    return spark.createDataFrame([(*r, "f", None, "s", "n", "z", 9, "p", "r", None, "w", "d") for r in rows], fields)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


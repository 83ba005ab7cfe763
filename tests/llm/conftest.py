import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents, with columns whose names clash with those the operators add."""
    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class int, size string, m string"
        return spark.createDataFrame(
            [(i, t, "en", None if t is None else f"s{len(t) % 3}", None, None, 1, "x", "y") for i, t in rows], schema
        )

    return build


@pytest.fixture
def rng():
    return random.Random(5)

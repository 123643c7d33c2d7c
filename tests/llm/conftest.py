import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["_row", "_hash", "_text", "_score", "_lines", "_kept", "_d", "_t", "k", "n", "h", "text_hash", "hits", "edits", "base", "spans", "term", "key", "found", "comp", "c"]


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary):04d}x" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from {doc_id: text} or (doc_id, text) pairs, with clashing extra columns on request."""

    def make(rows, clash=False):
        pairs = list(rows.items()) if isinstance(rows, dict) else list(rows)
        df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs], SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
        return df

    return make


@pytest.fixture
def rng():
    return random.Random(7)

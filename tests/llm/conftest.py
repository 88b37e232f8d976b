import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from texts, or from (doc_id, text, source) rows."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (i, r, "s") for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in full], DOCS)

    return make


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "the", "of", "une", "été", "größe", "x1", "end.", "comma,", "###", "longerword"]
    return " ".join(draw.choice(words) + draw.choice(["", "", "s", "\n"]) for _ in range(n))


#: Null, empty, blank and very long texts, repeated rows, ties, and ids that are null or repeated.
HARD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one two", None), (6, prose(1, 40), "a"), (6, prose(1, 40), "a"),
    (7, prose(1, 40), "b"), (8, prose(2, 3000), "a"), (9, prose(3, 300), "c"), (9, prose(4, 50), "c"), (None, prose(5, 30), None), (10, "same line here again\n" * 30, "a"),
]


@pytest.fixture(scope="session")
def hard(frame):
    return frame(HARD)


@pytest.fixture(scope="session")
def clashing(frame):
    """The hard rows with more columns, by names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["h", "k", "row", "at", "size", "start", "length", "sequence_id", "fingerprint", "component", "words", "host", "kept", "removed", "bucket", "sid", "n", "hash", "key", "blob", "spans", "taken", "_", "a b", "a.b", "a-b", "a`b", "select"]
    return frame(HARD).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))

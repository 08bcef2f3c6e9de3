import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, size string, fp string, node string, rows string"
VOCABULARY = ["w%d" % i for i in range(300)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def awkward_rows():
    """Nulls everywhere, blank and long texts, ties, repeated rows, odd white space."""
    base = prose(1, 120)
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, base + " tail", "en", None), (None, None, None, None),
            (None, "", "en", "a"), (4, "  \n\t ", "en", "a"), (5, prose(2, 6000), "de", "a"), (6, "one", "en", "c"), (7, "ONE", "en", "c"),
            (8, prose(3, 90) + "\n" + prose(3, 90), None, "c"), (8, "two words", "fr", "c"), (9, prose(4, 30).upper(), "en", "c"),
            (10, "é日本\u00a0語 x\x1cy", "en", "d"), (None, base, "en", "a")]
    return [(i, t, lang, s, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

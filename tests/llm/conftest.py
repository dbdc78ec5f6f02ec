import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, size long, key string, bucket long, content string, score double, taken long"
EXTRA = (True, "d", 5, "k", 7, "c", 0.5, 9)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, a hot source, names that clash."""
    rng = random.Random(3)
    long = words(rng, 40_000)
    near = words(rng, 120)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", None), (4, "one", "en", None, 3), (5, long, "en", "a", len(long)),
        (6, "Same text here", "en", "b", 14), (7, "Same  text\there", "de", "b", 15), (8, "Same  text here", "de", None, 15), (8, "Same  text here", "de", None, 15),
        (None, "nobody's words", None, None, None), (None, "nobody's words", None, None, None), (None, "one", None, "a", 3), (9, near, "en", "c", 0), (10, near + " tail", "en", "c", 0),
        (11, near.replace("w1 ", "W1 "), "en", "a", 0), (12, near.split(" ", 60)[60] + " other end", "en", "a", 0), (-5, "ünïcödé wörds 日本 text", "fr", "é", 0),
    ]
    rows += [(100 + k, "hot copy of one text", "en", "a", 20) for k in range(60)]
    rows += [(1000 + k, words(rng, rng.randrange(1, 60)), "en", "a" if k % 3 else "b", 1) for k in range(120)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in odd_rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

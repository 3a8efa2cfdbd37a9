import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\v\f\r"


def words_of(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_documents():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, other scripts, odd white space."""
    rng = random.Random(7)
    base, passage = words_of(rng, 150, 5000), words_of(rng, 60, 5000)
    near = base.split()
    near[70] = "changed"
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "b", 1), (4, None, "en", "a", None),
            (5, "", None, None, 0), (6, "   \n\t ", "de", "a", 5), (7, words_of(rng, 30_000, 20_000), "en", "a", 1), (None, base, "en", None, 1),
            (8, words_of(rng, 40, 5000) + " " + passage + " end", "en", "a", 1), (9, passage + " " + words_of(rng, 25, 5000), "de", "b", 1),
            (10, "one two three", "en", "a", 13), (11, "One two THREE", "en", "a", 13), (12, "one two\x1cthree   four ÄÖ ſ K ß 日本", "fr", "a", 9),
            (13, "ab " * 200, "en", "a", 600), (14, "x" * 700, "en", "a", 700), (15, "Zeile\nZeile\n\nZeile \r\n#$%", "de", None, 3)]
    rows += [(16 + k, words_of(rng, 20 + 30 * k), ("en", "de")[k % 2], "a", 1) for k in range(12)]
    return rows + [rows[0], rows[8], rows[3]]                 # rows that repeat


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns that operators use as names of their own."""
    from pyspark.sql import functions as F

    names = ("chunk", "id", "bucket", "node", "token", "keys", "row", "start", "n_words", "label", "item", "shard", "_id", "_text", "w", "sh", "kept")
    return odd.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

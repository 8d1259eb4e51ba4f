import random

import pytest

EXTRA = ["id", "row", "size", "shard", "h", "t", "len", "g", "cls", "tokens", "probability", "u", "tail", "hit1", "fine_range", "part"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(n))


def nasty():
    """(doc_id, text, lang, source): copies, near copies, nulls, empty, blank, long and odd texts, a hot text, a null id."""
    rng = random.Random(5)
    rows, base = [], words(rng, 120)
    for i in range(40):
        rows.append((i, words(rng, rng.randint(1, 80)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])))
    for i in range(40, 60):  # a third of all rows: one text
        rows.append((i, "The same text over and over again, word by word.", "en", "a"))
    for i in range(60, 72):  # near copies
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "b"))
    small = words(rng, 9)
    rows += [(72, small, "fr", "b"), (73, small + " x", "fr", "b"), (74, small.upper(), "fr", "b")]
    rows += [(75, None, "en", "a"), (76, "", "en", "a"), (77, " \n\t ", None, "a"), (78, "123 456 ...", "en", None), (79, "one two", "en", "a"), (80, "one two", "en", "a"),
             (81, words(rng, 20_000), "en", "a"), (82, "漢字 かな 😀 İstanbul Σίσυφος don't <|endoftext|> a b\u001cc", "en", "a"), (83, "x" * 5000, "en", "a"),
             (83, "x" * 5000, "en", "a"), (None, "a text without an id", "en", "a")]
    return rows


@pytest.fixture(scope="session")
def nasty_rows():
    return nasty()


@pytest.fixture(scope="session")
def nasty_docs(spark, nasty_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(nasty_rows, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit(-7) for c in EXTRA})


@pytest.fixture(scope="session")
def no_docs(nasty_docs):
    return nasty_docs.where("doc_id < -1")

import random

import pytest

WORDS = ("the red fox runs over a quiet river while small birds sing near old stone walls and green "
         "fields under bright morning skies of early spring days when people walk home").split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Null, empty, blank, tiny, very long, repeated, near and odd texts; null ids and columns."""
    base = prose(1, 120)
    near = base.replace("fox", "dog", 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, None, "b"), (4, None, "en", None), (5, "", "fr", "a"),
        (6, " \t\n\n ", "fr", None), (7, "one two", "en", "a"), (8, "ONE TWO", "en", "a"), (9, prose(2, 30_000), "de", "b"),
        (10, "x" * 60_000, "de", "b"), (11, "é" * 200 + " 全角 🎉\x00　▁▁ end", "es", "c"),
        (12, "mail a.b@c.de or 10.0.0.1, 4111 1111 1111 1111, +1 (555) 010-9999; password = hunter22hunter", "en", "c"),
        (13, prose(3, 200) + " " + prose(4, 40), "en", "c"), (14, prose(5, 90) + "\n" + prose(4, 40) + "\n" + prose(6, 90), "en", "c"),
        (15, "you are an idiot, said nobody. Café!", "en", "d"), (16, "!!!! !!!! !!!!\n!!!!\n!!!!", "en", "d"),
        (None, base, "en", "a"), (None, None, None, None), (12, "other text under a repeated id", "en", "c"), (1, base, "en", "a"),
    ]
    return [(i, t, lang, s, len(t) if t else None, "x", 7) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """With extra columns whose names clash with those the operators make."""
    return spark.createDataFrame(hard_rows, "doc_id long, text string, lang string, source string, n_chars long, score string, row int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, hard):
    return hard.where("false")


@pytest.fixture(scope="session")
def items(spark):
    rows = [(1, prose(4, 25), "x"), (2, "one two", "x"), (3, None, None), (4, "", "x"), (5, prose(4, 25), "x"), (6, "red1 fox2", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i == 15)) for i in range(1, 17)] + [(15, 0, 0), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(3)
    return ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def messy(spark, words):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(60)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, base, "en", "s"), (2, base, "en", "s"), (3, " ".join(near), None, "s"), (4, None, "en", None), (5, "", None, "s"), (6, "   \n\t ", "de", "s"),
        (7, text(20_000), "en", "s"), (8, "x", "de", "s"), (9, "x", "de", "s"), (None, text(30), "en", "s"), (None, None, None, None),
        (10, text(40), "en", "s"), (10, "other " + text(12), "en", "s"), (11, base, "en", "s"), (11, base, "en", "s"), (12, "%%% 123 !!", "en", "s"),
    ]
    rows += [(100 + i, text(r.randint(5, 80)), r.choice(["en", "de"]), "hot") for i in range(40)]
    full = [(*x, i, f"k{i}", 0.5, i % 3) for i, x in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score double, shard int")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.filter("false")

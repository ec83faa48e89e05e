"""A small table of documents with every awkward case."""

import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, shared = text(120), text(30)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, "one", "fr", "b"),
        (7, "one", "fr", None),
        (8, " \t\n\x0b ", "fr", "b"),
        (9, text(40) + " " + shared + " " + text(10), "fr", "c"),
        (10, shared + " " + text(25), "fr", "c"),
        (11, "é ü " * 20, "de", "c"),
        (12, text(20_000), "en", "a"),
        (13, "na " * 400, None, "d"),
        (14, "12345 !!! 678", "de", "d"),
        (15, "İstanbul ſecret Kelvin \U0001f600 " * 5, "de", "d"),
        (16, base.upper(), "en", "a"),
        (17, "A\x00B " * 30, "en", "é"),
        (None, shared, "en", "a"),
        (None, None, None, None),
    ]
    rows += [(i, text(rng.randint(1, 60)), rng.choice(["en", "fr"]), rng.choice("abcd")) for i in range(100, 140)]
    rows = [(*r, None if r[1] is None else len(r[1]), 7, "x") for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score bigint, block string")


@pytest.fixture(scope="session")
def pairs_of():
    return lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class long, n int, token string, _key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names clash with inner ones."""

    def make(rows, lang="en"):
        full = [
            (i, t, lang, "s", None if t is None else len(t), 7, 7, "t", "k") for i, t in rows
        ]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose of n words."""

    def make(n, seed, words=400):
        rng = random.Random(seed)
        vocabulary = random.Random(0)
        names = ["".join(vocabulary.choices("abdeilmnorstu", k=vocabulary.randint(2, 9))) for _ in range(words)]
        return " ".join(rng.choices(names, k=n))

    return make

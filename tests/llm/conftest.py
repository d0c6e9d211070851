from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}" for a in "ba co du fe gi lo mu ra se ti".split() for b in "n r s t l".split()]


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def prose(rng):
    def make(n: int) -> str:
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with columns whose names may clash."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), 0, "x", 1, True, "k") for r in rows]
        ddl = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, kept boolean, class string"
        return spark.createDataFrame(full, ddl).repartition(3)

    return make


#: Texts every operator must survive.
ODD = [
    (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (904, "one"), (None, "no id at all"), (None, None),
    (905, "x" * 70_000), (906, "word " * 30_000), (907, "é ü ñ 漢字 \U0001f600"), (908, "!!! ### %%%"),
]


@pytest.fixture
def odd():
    return ODD

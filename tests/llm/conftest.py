from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid string, tokens int, k1 string, label string, bucket int"
WORDS = ["the", "of", "to", "and", "is", *(f"w{i}x" for i in range(400))]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows and columns whose names operators use inside."""
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(6)]
    texts = [
        (1, base[0]), (1, base[0]), (2, base[0]), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, "ONE two three"), (None, base[1]), (None, None),
        (9, base[1]), (10, base[1].replace(" ", "  ")), (11, prose(rng, 12000)), (12, base[2] + " " + base[3]), (13, base[2] + " extra words"), (14, "né Ünïcode 中文 😀 \x00 ▁ <s> </s>"), (15, "x" * 5000), (16, base[4]), (16, base[5]),
    ]
    return [(i, t, "en", None, len(t or ""), "s", 1, "k", None, -1) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def doc(spark):
    """A documents table of texts, numbered from 0."""
    return lambda texts, n=3: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(n)


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)

"""Small tables with the awkward cases every operator must answer."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, t int, id int, u int, row int, s string"
SYLLABLES = ["ka", "lo", "mi", "ter", "an", "sel", "ou", "brin", "da", "ves", "tor", "ule"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) beside columns whose names operators use themselves."""
    full = [(i, t, lang, source, None if t is None else len(t), "k", 1, 2, 3, 4, None) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def random_rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, sentence(rng, rng.choice([3, 20, 80, 200])), rng.choice(["xx", "yy"]), rng.choice(["a", "a", "b", "c"])) for i in range(n)]


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows and equal texts."""
    rng = random.Random(2)
    passage = sentence(rng, 70)
    return [
        *random_rows(40),
        (100, None, "xx", "a"), (101, "", None, None), (102, " \n\t ", "yy", "b"), (103, "42 ... 7", None, "a"),
        (104, sentence(rng, 30_000), "xx", "c"), (105, "a" * 100_000, "xx", "c"),
        (106, passage, "xx", "a"), (107, passage, "yy", None), (107, passage, "yy", None), (108, "one two", "xx", "a"), (109, "one two", "xx", "b"),
        (110, "É ñ ß " * 50, "yy", "b"), (None, passage, None, None), (None, None, None, None),
        (111, f"{sentence(rng, 30)} {passage} {sentence(rng, 25)}", "xx", "a"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, awkward_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])

from __future__ import annotations

import random

import pytest

WORDS = ["the", "Of", "and", "über", "ciónes", "être", "x1", "don't", "end.", "a,b", "la", "der"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, kept boolean, parts int, rate string, cdf int, media int"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) + r.choice(["", "", "", str(r.randint(0, 999))]) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows() -> list[tuple]:
    """Null texts and keys, empty and blank texts, repeated rows, ties, long texts, odd characters."""
    long = prose(6_000, 1)
    base = prose(300, 2)
    near = base.replace("the", "thee", 1)
    rows = [(0, None), (1, ""), (2, "   \n"), (3, base), (4, base), (4, base), (5, near), (6, long), (7, long[:30_000] + " tail"), (None, "text without a key"), (None, None), (8, "İstanbul ſecret K"), (9, "\0 nul <|endoftext|> 💡  two  spaces\n\n"), (10, "!!! ??? 123"), (11, prose(40, 3) + " " + base[:700] + " " + prose(40, 4)), (12, prose(30, 5) + "\n" + base[300:1100]), (13, "ab" * 400), (-7, "one"), (14, "two words")]
    rows += [(100 + i, prose(60 + i, 50 + i)) for i in range(12)]
    return [(k, t, ("en", "fr", None)[i % 3], ("s0", "s1", None)[i % 3], len(t or "")) for i, (k, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The rows with further columns that have the names of results."""
    return spark.createDataFrame([(*r, "x", True, 1, "r", 2, 3) for r in hard_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_key(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)

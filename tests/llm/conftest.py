import random

import pytest

#: names that operators use inside, as columns of the input
CLASH = ["_id", "_text", "key", "bands", "a", "b", "group", "start", "_kept", "count", "h1", "_gone", "_bad", "q", "u"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    return " ".join(r.choice(vocab) for _ in range(n))


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), *["x"] * len(CLASH))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = prose(1, 60_000, 5000)
    rows = [row(1, prose(2, 120)), row(2, prose(2, 120)), row(3, None), row(4, ""), row(5, long), row(6, "one"), row(7, "one"), row(8, " \n\t"), row(9, "Größe ÉTÉ Ωmega 漢字 🙂 end"), row(9, "Größe ÉTÉ Ωmega 漢字 🙂 end"), row(None, prose(3, 50)), row(10, prose(4, 80), None, None), tuple([None] * (5 + len(CLASH))), row(11, prose(2, 118) + " w1 w2"), row(12, "x" * 200_000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""Small documents with every odd case, for all operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _size string, _copies int, text_sha256 int"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.3 else "".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty, blank, very long, ties, repeated rows, near copies, shared passages, a hot source."""
    rng = random.Random(11)
    shared = words(rng, 50)
    base = words(rng, 120)
    rows = [(None, "no id here at all", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\x0b ", "xx", "a"), (4, "one", "en", "b"), (5, "one", "en", "b"), (5, "one", "en", "b")]
    rows += [(6, words(rng, 20_000), "en", "hot"), (7, "x" * 50_000, "en", "hot"), (8, "È é ß €  \U0001f600 <|endoftext|> #### $$$", "fr", "ü")]
    rows += [(10 + k, words(rng, rng.randint(5, 60)), rng.choice(["en", "de", None]), "hot") for k in range(40)]
    rows += [(60 + k, words(rng, 30) + " " + shared + " " + words(rng, 10), "en", rng.choice("abc")) for k in range(6)]
    for k in range(12):
        own = base.split()
        own[rng.randrange(len(own))] = f"edit{k}"
        rows.append((80 + k, " ".join(own) if k else base.upper(), "en", "hot"))
    rows += [(100, base, "en", "z"), (101, base, "en", None), (-3, "minus one two three four", "en", "a"), (None, None, None, None), (None, base, "en", "a")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), True, "x", 7, 3) for i, t, la, s in odd_rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")

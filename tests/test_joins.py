"""The joins against the matcher over every pair."""

from __future__ import annotations

import pytest

from loomtext.operators import fuzzy_join, joins, named_list_join, substring_join
from loomtext.pattern.engine import compile, escape
from loomtext.pattern.flags import Flag

TEXTS = [
    (1, "a widget foobar"), (1, "nothing"), (1, "widget, widget"), (2, "wigdet in New York"), (None, "new york new york"), (None, "the STRAßE of the e-mail"), (3, None), (4, ""), (5, "newyork e-mails xnew york"),
    (6, "Strasse und strasse"), (2, "wigdet in New York"), (7, "foobaz E-MAIL"),
]
WORDS = ["widget", "foobar", "new york", "e-mail", "strasse", "the", "york"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "k long, t string").repartition(3)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in [*WORDS, None, WORDS[0]]], "w string")


@pytest.fixture(params=["broadcast", "merge"])
def way(request, monkeypatch):
    if request.param == "merge":
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(joins, "FEW_WORDS", 3)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("flags", [Flag.NONE, Flag.IGNORECASE])
def test_named_list(texts, words, flags, way):
    want = {}
    for k, t in TEXTS:
        for w in WORDS:
            if t and (n := compile(rf"\b{escape(w)}\b", flags).count(t)):
                want[k, w] = want.get((k, w), 0) + n
    assert found(named_list_join(texts, "k", "t", words, "w", flags)) == sorted(((*kw, n) for kw, n in want.items()), key=repr)
    assert want[None, "new york"] == 2


def test_substring(texts, words, way):
    want = sorted(((k, w) for k, t in TEXTS for w in WORDS if t and w in t), key=repr)
    assert found(substring_join(texts, "k", "t", words, "w")) == want


@pytest.mark.parametrize("flags", [Flag.NONE, Flag.IGNORECASE])
@pytest.mark.parametrize("errors", [0, 1, 2])
def test_fuzzy(texts, words, flags, errors, way):
    want = sorted(((k, w) for k, t in TEXTS for w in WORDS if t is not None and compile(f"(?:{escape(w)}){{e<={errors}}}", flags).is_match(t)), key=repr)
    assert found(fuzzy_join(texts, "k", "t", words, "w", errors, flags)) == want
    assert (1, "widget") in want

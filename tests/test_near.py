"""Fuzzy tests in the JVM give the matcher's answers."""

from __future__ import annotations

import random

import pytest

import loomtext.functions as fz
from loomtext.functions.columns import tier
from loomtext.pattern.engine import compile

PATTERNS = [
    "(?:abcab){e<=1}", "(?:abcabc){e<=2}", "(?i)(?:ssab stb){e<=2}", "(?i)(?:abss){e<=1}", r"(?i)(?:ab-ca|b\.ab\n){e<=1}", "(?:aabbaabb){e<=3}", "(?i)(?:straße){e<=1}", "(?:ab){e<=1}", "(?:abcab){e<=0}",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_near(spark, pattern):
    rng = random.Random(pattern)
    own = compile(pattern)
    pool = "abcst" * 3 + "AS -.\nß\U0001f600ſﬆK" + "x"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    base = {"(?:abcabc){e<=2}": "abcabc", "(?i)(?:ssab stb){e<=2}": "ssab stb", "(?:aabbaabb){e<=3}": "aabbaabb", "(?i)(?:straße){e<=1}": "strasse"}.get(pattern, "abcab")
    for _ in range(800):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(pool)])
        texts.append("".join(rng.choice(["", "x", "\U0001f600"]) + "".join(t) + rng.choice(["", "y ", "ß"])))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k long, t string").select("k", "t", fz.is_match("t", pattern).alias("x"))
    if pattern != "(?:abcab){e<=0}":
        assert tier(pattern) == "near" and "Python" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        assert r.x == (None if r.t is None else own.is_match(r.t)), (pattern, r.t)


@pytest.mark.parametrize("pattern", ["(?:abc){s<=1}", "(?:abc){e<=1:[a-z]}", "(?:abcdef){1<=e<=2}", "(?:" + "abcdefghij" * 30 + "){e<=3}"])
def test_more_than_distance(pattern):
    assert tier(pattern) != "near"


ECHOES = [
    r"(\w\w)\w* \w*(?:\1){s<=1}", r"(a.b)x?(?:\1){s<=2}", r"(?i)(k)([ab].)s*(?-i:(?:\2){s<=1})", r"^(?:(a)|([bc]{3})) (?:\2){s<=1}", r"(.)(\S\S)(?:\2){s<=1,e<=1}\1", r"(\w{3})(?:-(?:\1){s<=1}){1,2}$", r"(?s)(..) (?=(?:\1){s<=1})",
]


@pytest.mark.parametrize("pattern", ECHOES)
def test_echo(spark, pattern):
    """Backreferences with substitutions are tested in the JVM; before, by the backtracking matcher for each text."""
    rng = random.Random(pattern)
    own = compile(pattern)
    pool = "abcks" * 3 + "ABK  --\n\U0001f600K\u0301x"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for _ in range(800):
        t = [rng.choice(pool) for _ in range(3)]
        echo = [c if rng.random() < 0.7 else rng.choice(pool) for c in t]
        texts.append("".join([*t, rng.choice(["", " ", "-", "x", "b x"]), *echo[rng.randint(0, 1) :], rng.choice(["", t[0], "-" + "".join(t)])]))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k long, t string").select("k", "t", fz.is_match("t", pattern).alias("x"))
    assert tier(pattern) == "near" and "Python" not in df._jdf.queryExecution().toString()
    rows = df.collect()
    for r in rows:
        assert r.x == (None if r.t is None else own.is_match(r.t)), (pattern, r.t)
    assert {r.x for r in rows} == {True, False, None}


@pytest.mark.parametrize("pattern", [r"(\w+) (?:\1){s<=1}", r"(\w\w)(?:\1){s<=2}", r"(\w\w)(?:\1){e<=1}", r"(\w\w)(?:\1){s<=1:[a-z]}", r"(?:(\w\w) )+(?:\1){s<=1}", r"(?i)(\w\w)(?:\1){s<=1}", r"(\w\w)(?:x(?:\1){s<=1}){e<=1}", r"(?r)(\w\w)(?:\1){s<=1}", r"(\w\w)(?:ab){s<=1}"])
def test_more_than_an_echo(pattern):
    assert tier(pattern) != "near"

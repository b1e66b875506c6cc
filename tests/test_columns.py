"""The column API agrees with the matcher, whichever tier it picks, and null stays null."""

from __future__ import annotations

import random

import pytest

import loomtext.functions as fz
from loomtext.operators import explode_matches, fuzzy_join, named_list_join, next_match, pattern_join, substring_join
from loomtext.pattern.engine import Pattern, compile
from loomtext.plans import catalog

TEXTS = ["the dog and foxbar", "Café STRASSE straße", "a1b22c333", "", "line one\nline two\r\n", "xy ıİ kKK"]
PATTERNS = [r"\w+", r"\bo?n?\w", r"(?i)strasse", r"(?m)^\w+$", r"[^\W\d]+\d", r".+", r"\s", r"(?:fox|dog)+", r"(?a)\w+", r"\p{Lu}\w*", r"(?i)k", "[[a-z]&&[^aeiou]]{2}", r"(?<=a)\d", r"(?>a|ab)\d", "(?:foobar){e<=1}", r"(o)(\w)?", "(?i)I", r"\W+", r"\S+", r"\D", r"[^\s\d]+", r"\b\w", r"(?a)\b\w+\b", r"\B."]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id int, t string")


def test_tiers_agree(texts):
    cols = {}
    for k, p in enumerate(PATTERNS):
        cols[f"m{k}"], cols[f"s{k}"], cols[f"f{k}"], cols[f"c{k}"] = fz.is_match("t", p), fz.is_match_at_start("t", p), fz.is_full_match("t", p), fz.count("t", p)
        cols[f"r{k}"], cols[f"p{k}"], cols[f"a{k}"] = fz.replace("t", p, "<>"), fz.split("t", p), fz.findall("t", p)
    rows = texts.select("id", *[c.alias(n) for n, c in cols.items()]).orderBy("id").collect()
    for text, row in zip(TEXTS, rows, strict=False):
        for k, p in enumerate(PATTERNS):
            q = compile(p)
            got = [row[f"{n}{k}"] for n in "msfcrpa"]
            assert got == [q.is_match(text), q.is_match_at_start(text), q.is_full_match(text), q.count(text), q.replace(text, "<>"), q.split(text), [m.value for m in q.iterate(text)]], (p, text)
    assert all(rows[-1][n] is None for n in cols)


def test_records(texts):
    row = texts.where("id = 0").select(fz.search("t", "(?<w>(?:foobar){e<=1})").alias("m"), fz.replace_n("t", "o", "0").alias("n"), fz.replace_with("t", r"\w+", lambda m: m.value[::-1], count=1).alias("w")).first()
    assert (row.m["index"], row.m.length, row.m.value, row.m.subs, row.m.changes.subs, row.m.last_group_name) == (12, 6, "foxbar", 1, [14], "w")
    assert tuple(row.n) == ("the d0g and f0xbar", 2) and row.w == "eht dog and foxbar"


def test_tier_choice():
    assert [fz.tier(p) for p in ("abc", r"\d+", "(?:hello){e<=1}", "(?:hello){s<=1}", "(a|b)*", "(?r)a", r"(?|(a)|(b))\1")] == ["literal", "java", "near", "filtered", "matcher", "matcher", "matcher"]


def test_rows(texts):
    rows = next_match(explode_matches(texts.where("id = 2"), "t", r"\d+"), ["id"]).orderBy("ordinal").collect()
    assert [(r.match.value, r.next and r.next.value) for r in rows] == [("1", "22"), ("22", "333"), ("333", None)]


def test_joins(spark, texts):
    words = spark.createDataFrame([("dog",), ("line",), ("fox",), (None,)], "word string")
    assert sorted(map(tuple, named_list_join(texts, "id", "t", words, "word").collect())) == [(0, "dog", 1), (4, "line", 2)]
    assert sorted(map(tuple, substring_join(texts, "id", "t", words, "word").collect())) == [(0, "dog"), (0, "fox"), (4, "line")]
    near = spark.createDataFrame([("foobar",), ("lime ome",)], "word string")
    assert sorted(map(tuple, fuzzy_join(texts, "id", "t", near, "word", 2).collect())) == [(0, "foobar"), (4, "lime ome")]
    assert sorted(map(tuple, pattern_join(texts, "id", "t", [(1, r"\d+"), (2, "o")]).collect())) == [(0, 2, 2), (2, 1, 3), (4, 2, 2)]


def test_sql(spark, texts):
    fz.register(spark)
    texts.createOrReplaceTempView("texts")
    assert [r[0] for r in spark.sql("SELECT fz_count(t, '[0-9]+') FROM texts ORDER BY id").collect()] == [0, 0, 3, 0, 0, 0, None]
    assert [r.value for r in spark.sql("SELECT m.value FROM texts, LATERAL fz_matches(t, '(?:dog|fox){e<=0}') m ORDER BY 1").collect()] == ["dog", "fox"]


def test_budgets(spark):
    df = spark.createDataFrame([("x" * 30,), ("xy",)], "t string")
    p = compile(r"(?:(x+)+\1)+y", steps=500, on_timeout="null")
    assert [r[0] for r in df.select(fz.is_match("t", p)).collect()] == [None, False]
    assert [r[0] for r in df.select(fz.count("t", compile("x", steps=500))).collect()] == [30, 1]


def test_equal_texts(spark):
    """Texts of a batch that are equal are matched once; each row gets its own text's result, null for null."""
    texts = ["b1", None, "a1", "b1", "", "a1", "b1", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)

    def counter():
        calls = []
        return lambda m: calls.append(m) or f"{m.value}-{len(calls)}"

    rows = df.select("id", fz.replace_with("t", "[ab]", counter()).alias("r"), fz.search("t", "([ab])1").alias("m"), fz.split("t", "(?r)1").alias("s")).orderBy("id").collect()
    assert len({r.r for r in rows if r.r}) == 2
    assert [r.m and r.m.groups[1].value for r in rows] == [t and t[:1] or None for t in texts]
    assert [r.s for r in rows] == [t if t is None else compile("(?r)1").split(t) for t in texts]
    assert [r.m for r in df.where("t is null").select(fz.search("t", "(?r)a").alias("m")).collect()] == [None, None]


def test_work_is_dealt_out(spark, sf):
    """A small file of short texts is one split, however long each takes."""
    for name in ("a30_timeout_null", "g05_best_across_rows", "z11_best", "z12_fuzzy_set"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Python") < plan.index("Repartition 24"), name


def test_wide_lines(spark):
    """Line ends of the WORD flag are found in the JVM, and by Python's own matcher in Latin-1 texts; before, each text went through the
    backtracking matcher."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\r\r\n\x0b\x0c\x85\u2028\u2029é\U0001f600")  for _ in range(rng.randint(0, 9))) for _ in range(600)] + ["", "\r\n", "a\r\n", "a\r", "a\n\r", "a\r\n\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    patterns = [r"(?wm)\w$", r"(?wm)^\w", r"(?wm)^.", r"(?wm).$", r"(?w)\w$", r"(?w)^\w", r"(?w).$", r"(?wm)\s$", r"(?wm)^\s", r"(?w)\s$", r"(?w).+", r"(?wm)\n^\r?"]
    assert all(fz.tier(p, what="count") == "java" for p in patterns) and fz.tier(r"(?w)\bx") == "matcher"
    got = df.select("t", *[fz.count("t", p).alias(f"c{k}") for k, p in enumerate(patterns)], *[fz.is_match("t", p).alias(f"m{k}") for k, p in enumerate(patterns)])
    assert "Python" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    for k, p in enumerate(patterns):
        q, slow = compile(p), Pattern(p)
        assert q.quick is not None, p
        slow.quick = slow.quick_records = None
        for r in rows:
            want = (None, None) if r.t is None else (slow.count(r.t), slow.is_match(r.t))
            assert (r[f"c{k}"], r[f"m{k}"]) == want, (p, r.t)
            assert r.t is None or (q.count(r.t), q.is_match(r.t)) == want, (p, r.t)
            assert r.t is None or [m.value for m in q.iterate(r.t)] == [m.value for m in slow.iterate(r.t)], (p, r.t)

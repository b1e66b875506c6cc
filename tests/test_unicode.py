"""Unicode data and segmentation, against the regex package."""

from __future__ import annotations

import random

import pytest

from loomtext.pattern.engine import compile
from loomtext.pattern.errors import PatternError
from loomtext.pattern.segments import default_boundary, grapheme_end

regex = pytest.importorskip("regex")

POOL = "ab1 \r\n\t.,':_\"é́‍‌\U0001f468\U0001f469\U0001f3fd\U0001f1e6\U0001f1e7क्षि각가각אבカヲ؀ः⁠日本“”’·ൎകক"


def texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_clusters():
    for t in texts(4000):
        i, got = 0, []
        while i < len(t):
            got.append(t[i : grapheme_end(t, i)])
            i += len(got[-1])
        assert got == regex.findall(r"\X", t), ascii(t)


def test_default_boundaries():
    for t in texts(4001):
        assert [i for i in range(len(t) + 1) if default_boundary(t, i)] == [m.start() for m in regex.finditer(r"(?w)\b", t)], ascii(t)


PROPERTIES = """Vai Bamum Script=Han Script=Katakana Latin Block=Tibetan InGreekExtended IsCyrillic scx=Deva nv=1/2 NumericValue=7 Bidi_Class=R ea=F East_Asian_Width=W Line_Break=OP ccc=230
Canonical_Combining_Class=9 Emoji Extended_Pictographic GCB=T GCB=Prepend WB=Katakana InCB=Linker IDS Joining_Group=Ain Joining_Type=D dt=Wide Hangul_Syllable_Type=LV Sentence_Break=STerm Alphabetic
Lu Letter Uppercase Script:Cyrillic Greek Common Zyyy Dash Hex_Digit XIDS""".split()
SPOTS = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x400), 0x2126, 0x212A, 0x3007, 0xFF71, 0xFF21, 0xA500, 0xA6A0, 0xF40, 0x1F00, 0x431, 0x915, 0x94D, 0xBD, 0x5D0, 0x639, 0xAC00, 0x1F600, 0x11A8, 0x600)]


@pytest.mark.parametrize("name", PROPERTIES)
def test_properties(name):
    for form in (rf"\p{{{name}}}", rf"\P{{{name}}}", rf"[[:{name}:]]", rf"[[:^{name}:]x]"):
        own, there = compile(form), regex.compile(form, regex.V1)
        assert [c for c in SPOTS if own.is_full_match(c)] == [c for c in SPOTS if there.fullmatch(c)], form


def test_properties_in_java(spark):
    import loomtext.functions as fz

    chars = spark.createDataFrame([(c,) for c in SPOTS], "c string")
    for name in ("Script=Cyrillic", "Greek", "Block=Tibetan", "nv=1/2", "Latin"):
        got = chars.where(fz.is_match("c", rf"\p{{{name}}}")).collect()
        assert {r.c for r in got} == {c for c in SPOTS if regex.match(rf"\p{{{name}}}", c)}


@pytest.mark.parametrize("pattern", [r"(?:ab){e<=1x}", "ab{e<=1", "ab{e", "a{s<=1:}", "[[:foo:]]", r"\p{Nonsense}", r"\p{Script=Nowhere}"])
def test_refused(pattern):
    """What is refused, and why, is as there."""
    with pytest.raises(PatternError) as own:
        compile(pattern)
    with pytest.raises(regex.error) as there:
        regex.compile(pattern, regex.V1)
    assert str(own.value).split(" at ")[0] == there.value.msg

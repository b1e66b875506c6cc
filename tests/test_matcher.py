"""Answers of the matcher: spans, groups, edits."""

from __future__ import annotations

import random

import pytest

from loomtext.pattern.engine import Pattern, compile, escape
from loomtext.pattern.errors import MatchTimeout, PatternError

#: Subjects of published answers; so are the patterns and spans that go with them.
FARM = "molasses anaconda foo bar baz smith anderson "
SNAKE = "anaconda foo bar baz smith anderson"
SCATTERED = "3oifaowefbaoraofuiebofasebfaobfaorfeoaro"


def span(m):
    return m and (m.index, m.end)


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("(foobar){i<=2,s<=2,e<=2}", "oobargoobaploowap", (5, 11)),
        ("(foobar){i<=1,d<=2,s<=3,2d+1s<4}", SCATTERED, (6, 13)),
        ("(?b)(foobar){e}", "xirefoabralfobarxie", (11, 16)),
        ("(?e)(foobar){e}", "xirefoabralfobarxie", (0, 3)),
        ("(znacnda){s<=1,e<=3,1i+1d<2}", FARM, (9, 17)),
        ("(ananda){1i+1d<2}", FARM, None),
        ("(fuu){i<=3,d<=3,e<=5}", SNAKE, (0, 0)),
        ("(fuu){i<=2,d<=2,e<=5}", SNAKE, (7, 10)),
        ("(?:abbcb){e<=1}", "babbccc", (1, 6)),
        ("(?:ab){d<=1}b", "abxabb", (0, 2)),
        ("(?e)(?:abc){e<=1}", "abxabc", (0, 3)),
        ("(?b)(?:abc){e<=1}", "abxabc", (3, 6)),
        ("(?b)(?:abcd){3i+1s<=3}", "axyd abXcd", (0, 4)),
        ("(?p)a|ab|abc", "abcd", (0, 3)),
        (r"(?r)\w+", "one two three", (8, 13)),
        (r"[\w-[\d]]+", "abc123-", (0, 7)),
        ("(?i)ß", "SS", (0, 2)),
        ("^(?:(?(1)c|z)|())*$", "c", (0, 1)),
        ("(a+)+c", "a" * 200 + "b", None),
        ("(?<=a+)b", "caab", (3, 4)),
        (r"foo\Kbar", "foobar", (3, 6)),
        (r"(?:qx){1<=d}", "qx{1<=d}", (0, 8)),
    ],
)
def test_spans(pattern, text, want):
    assert span(compile(pattern).search(text)) == want


@pytest.mark.parametrize(
    ("pattern", "text", "counts"),
    [("^(foobar){e<=1}$", "foxbar", (1, 0, 0)), ("(dog){e<=1}", "the dog", (0, 1, 0)), ("(?e)(dog){e<=1}", "the dog", (0, 0, 0)), ("^(?:dog){e<=1}", " dog", (0, 1, 0)), ("(?:a){d<=1}a", "a", (0, 0, 1)),
     ("(?:[0-9]+){d<=2}", "42kg", (0, 0, 0))],
)
def test_counts(pattern, text, counts):
    assert compile(pattern).search(text).fuzzy_counts == counts


def test_minimum_of_errors():
    p = compile("(?:service detection){0<e<5}")
    assert [span(p.match_at_start(t)) for t in ("servic detection", "service detection", "in service detection")] == [(0, 16), (0, 16), (0, 20)]
    assert p.match_at_start("service detection").fuzzy_counts == (0, 0, 1)


def test_changes():
    p = compile("(?:foobar){e<2}")
    assert [p.full_match(t).fuzzy_changes for t in ("foxbar", "fooxbar", "fobar")] == [([2], [], []), ([], [3], []), ([], [], [2])]
    assert compile("(?:ab){d<=1}(?:ab){d<=1}").search("aa").fuzzy_changes[2] == [1, 3]


def test_edit_tests():
    assert [compile("(?:a){e<=1:[a-z]}").is_full_match(t) for t in ("ae", "a-")] == [True, False]
    assert compile("(?:ab){s<=1,d<=1:x}").is_full_match("a")
    assert not compile("(?:ab){s<=1,i<=1:x}").is_full_match("azb")


def test_scans():
    assert [m.index for m in compile("(?:dog){e<=1}").matches("dog dog dog")] == [0, 4, 8]
    assert [m.value for m in compile(r"\m(?:Y){i}\M").matches("XY YX")] == ["XY", "YX"]
    assert [m.value for m in compile("(|a)").matches("a")] == ["", "a", ""]
    assert [m.value for m in compile("(?r)..").matches("abcde")] == ["de", "bc"]
    assert [m.value for m in compile("..").matches("abcde", overlapped=True)] == ["ab", "bc", "cd", "de"]
    assert [m.value for m in compile(r"(?e)\b\L<words>{e<=1}\b", lists={"words": ["cat", "dog"]}).matches(" book dog cot desk ")] == ["dog", "cot"]
    m = compile("a|b").search("ab")
    assert (m.value, m.next_match().value, m.next_match().next_match()) == ("a", "b", None)


def test_partial():
    p = compile(r"\d{4}-\d{2}-\d{2}")
    assert [(m.partial, span(m)) for m in (p.search(t, partial=True) for t in ("2026-09", "not a date", "2026-0b"))] == [(True, (0, 7)), (True, (10, 10)), (True, (7, 7))]
    assert span(compile("(?e)(dog){e<=1}").search("cat and d", partial=True)) == (7, 9)
    assert span(compile("(?:ab){1<=i<=2}").search("xxa", partial=True)) == (0, 3)


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        (":*", ":a:b::c", ["", "", "a", "", "b", "", "c", ""]),
        ("(:)*", ":a:b::c", ["", ":", "", None, "a", ":", "", None, "b", ":", "", None, "c", None, ""]),
        ("(b)|(:+)", ":a:b::c", ["", None, ":", "a", None, ":", "", "b", None, "", None, "::", "c"]),
        ("(?r)(x)|(y)", "xaxbxc", ["c", "x", None, "b", "x", None, "a", "x", None, ""]),
    ],
)
def test_split(pattern, text, want):
    assert compile(pattern).split(text) == want


def test_replace():
    assert compile("(?i)b+").replace("bbbb BBBB", "x") == "x x"
    assert compile(r"(\w+) (\w+)").replace("hello world", r"\2 \1") == "world hello"
    assert compile(r"(\w)+").replace_format("abc", "{1[0]}{1[-1]}") == "ac"
    assert compile("a").replace_n("aaa", "b", 2) == ("bba", 2)
    assert compile("(?r)a").replace_n("aaa", "b", 2) == ("abb", 2)
    with pytest.raises(PatternError):
        compile("a").replace("a", r"\q")


def test_structure():
    assert compile(r"(?P<n>\((?:[^()]|(?&n))*\))").search("x(a(b)c)y").value == "(a(b)c)"
    assert compile("(?|(a)|(b))").search("b").group(1) == "b"
    assert [c.value for c in compile(r"(?:(\w)\w* ?)+").search("red bolt").captures(1)] == ["r", "b"]
    assert compile(r"\w+(*PRUNE)\d").search("ab1") is None
    assert [m.value for m in compile(r"\X").matches("é\U0001f1eb\U0001f1f7x")] == ["é", "\U0001f1eb\U0001f1f7", "x"]
    assert compile(r"^(a|b)*$").is_match("ab" * 20000)
    assert compile("[[a-z]--[aeiou]]+").search("aebcd").value == "bcd"


@pytest.mark.parametrize("pattern", ["(abc", "a**", "*a", "a[", "a[b-a]", "abc)", r"\1", "(?P<1>a)", "(a)(?P=x)", "a\\", r"(?V0)(a\1)", "(?(DEFINE)a|b)", "(?b)(?:a){e<=1}(*SKIP)b", "(?<a>(?&a)x)"])
def test_refused(pattern):
    with pytest.raises(PatternError):
        compile(pattern)


def test_timeout():
    with pytest.raises(MatchTimeout):
        compile(r"(?:(x+)+\1)+y", steps=2000).is_match("x" * 40)


def test_escape_round_trip():
    for text in ("a.b", "[x](y){z}", "a b\tc", "1+1=2?", "\\d", "#&~-"):
        assert compile(escape(text)).is_full_match(text)
        assert compile(escape(text, special_only=False)).is_full_match(text)


def test_sieve_keeps_answers():
    """Skipping starts by pieces and by the bit-parallel scan changes no match."""
    rng = random.Random(3)
    for _ in range(200):
        k = rng.choice([1, 1, 2])
        word = "".join(rng.choice("abc") for _ in range(rng.randint(2 * k + 2, 8)))
        budget = rng.choice([f"e<={k}", f"s<={k}", f"i<={k}", f"d<={k}", f"2i+1d+1s<={k}"])
        pattern = rng.choice(["", "(?i)", "(?b)", "(?e)"]) + f"(?:{word}){{{budget}}}"
        text = "".join(rng.choice("abcA ") for _ in range(50))
        fast, slow = Pattern(pattern), Pattern(pattern)
        slow.machine.sieve = None
        assert [(m.index, m.end, m.fuzzy_changes) for m in fast.iterate(text)] == [(m.index, m.end, m.fuzzy_changes) for m in slow.iterate(text)], pattern
        assert fast.is_match(text) == slow.is_match(text), pattern


def test_quick_agrees():
    """Python's matcher over Latin-1 texts gives the machine's matches, groups and order."""
    rng = random.Random(8)
    atoms = ["a", "b", ".", r"\w", r"\d", "[ab]", "[^a]", r"\b", "^", "$", r"(?m)^", "(?=b)", "(?<!a)", "(a)", "(a|b)", "(?:ab|a)", r"\s", "(?i)\xe9", r"\R", r"(?:(b)|c)", r"\m", r"\W"]
    tails = ["", "", "", "*", "+", "?", "{2}", "{1,3}", "*?", "++", "??"]
    tried = 0
    for _ in range(1500):
        pattern = "".join(a + ("" if a in (r"\b", "^", "$", "(?m)^", r"\m") or a[:3] in ("(?=", "(?<") else rng.choice(tails)) for a in rng.choices(atoms, k=rng.randint(1, 4)))
        fast = Pattern(pattern)
        if fast.quick_records is None:
            continue
        tried += 1
        slow = Pattern(pattern)
        slow.quick = slow.quick_records = None
        text = "".join(rng.choice("aab \n\xe9\xc91c") for _ in range(15))
        view = lambda p: [(m.span(), m.groups(), m.last_group) for m in p.iterate(text)]  # noqa: E731, B023
        assert view(fast) == view(slow), (pattern, text)
        assert (fast.count(text), fast.is_match(text)) == (slow.count(text), slow.is_match(text))
    assert tried > 400


def test_node_budget():
    assert compile("a{50}", max_nodes=200).is_match("a" * 50)
    for pattern, most in (("a{200}", 200), ("(a{100}){100}", 500), ("((a{1000}){1000}){1000}", 1_000_000)):
        with pytest.raises(PatternError, match=str(most)):
            compile(pattern, max_nodes=most)
    with pytest.raises(ValueError, match="positive"):
        compile("a", max_nodes=0)
    with pytest.raises(PatternError, match="too deeply"):
        compile("(" * 600 + "a" + ")" * 600)
    assert compile("(" * 300 + "a" + ")" * 300).is_full_match("a")

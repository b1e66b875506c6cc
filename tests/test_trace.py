"""Paths by a table of distances are those that the backtracking matcher ends on."""

from __future__ import annotations

import random

import pytest

from loomtext.pattern.engine import Pattern, compile

SECTIONS = ["(?:abca){e}", "(?:ab ba){e<=2}", "(?:abcab){e<=4}", "(?i)(?:aBss){e<=3}", "(?if)(?:straße){e<=2}", "(?:aab){s,i,d}", "(?:aabb){e<=9}"]


def edits(m):
    return m and (m.index, m.length, m.found.edits, m.found.cost, m.found.captures, m.last_group)


def texts(seed: str, most: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("aaabbcAS st\nßx") for _ in range(rng.randint(0, most))) for _ in range(150)]


@pytest.mark.parametrize("flag", ["", "(?b)", "(?e)"])
@pytest.mark.parametrize("section", SECTIONS)
def test_whole(section, flag):
    own, slow = Pattern(flag + section), Pattern(flag + section)
    assert own.machine.trace is not None
    slow.machine.trace = None
    for t in texts(section, 7):
        for slice_ in ((0, -1), (1, 4)):
            assert edits(own.full_match(t, *slice_)) == edits(slow.full_match(t, *slice_)), t
            assert own.is_full_match(t, *slice_) == slow.is_full_match(t, *slice_)


def test_whole_takes_no_steps():
    """Before, each limit from the first path's errors down was searched whole, in hundreds of steps for a short name."""
    p = compile("(?b)(?:cold bald){e}")
    m = p.full_match("large ring")
    assert sum(m.fuzzy_counts) == 9 and p.machine.used < 10
    m = compile("(?b)(?:" + "cold bald" * 20 + "){e}").full_match("hot bolt " * 15)
    assert m.length == 135


@pytest.mark.parametrize("pattern", ["(?:abc){s<=1}", "(?:abc){2s+1i<=3}", "(?:abc){e<=2:[a-z]}", "(?:abc){1<=e<=2}", "(?r)(?:abc){e<=1}", "(?p)(?:abc){e<=1}", "((?:abc){e<=1})", "(?:a|b){e<=1}"])
def test_more_than_a_number(pattern):
    assert Pattern(pattern).machine.trace is None


#: Where every match must hold something, pieces tell where a search looks.
SEARCHED = ["(?:abca){e<=2}", "(?:ab ba){e<=4}", "(?i)(?:aBss){e<=3}", "(?if)(?:straße){e<=2}", "(?:aab){e<=1}", "(?:bab){e<3}", "(?:cabab){e<=0}"]


@pytest.mark.parametrize("flag", ["", "(?b)", "(?e)"])
@pytest.mark.parametrize("section", SEARCHED)
def test_search(section, flag):
    own, slow = Pattern(flag + section), Pattern(flag + section)
    assert own.machine.trace is not None and own.machine.sieve is not None
    slow.machine.trace = None
    for t in texts(section, 12) + texts(section + "b", 90)[:15]:
        assert [edits(m) for m in own.iterate(t)] == [edits(m) for m in slow.iterate(t)], t
        assert [edits(m) for m in own.matches(t, 2, 6, overlapped=True)] == [edits(m) for m in slow.matches(t, 2, 6, overlapped=True)], t
        assert edits(own.search(t, partial=True)) == edits(slow.search(t, partial=True)), t


def test_search_takes_no_steps():
    """Before, 648 steps: each start tried all paths of the least number of errors."""
    p = Pattern("(?b)(?:widget){e<=4}")
    assert p.search("cold ring") and p.machine.used < 10

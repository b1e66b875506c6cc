"""Where Unicode's text segmentation (UAX 29) has boundaries: grapheme clusters and words, by the classes of the Unicode data.

Word boundaries differ from the plain rules as the WORD flag's always have: an apostrophe is not parted from a vowel, the characters around
a middle letter are taken as they are, and after an odd regional indicator, or only what extends the start, there is none."""

from __future__ import annotations

from functools import lru_cache

from .charset import property_test

#: The classes that the rules name.
_CLUSTER = "CR LF Control Extend ZWJ Regional_Indicator Prepend SpacingMark L V T LV LVT".split()
_WORD = "CR LF Newline Extend ZWJ Format Regional_Indicator Katakana Hebrew_Letter ALetter Single_Quote Double_Quote MidNumLet MidLetter MidNum Numeric ExtendNumLet WSegSpace".split()
#: Hangul syllable parts that are not parted.
_JOINED = frozenset(["L L", "L V", "L LV", "L LVT", "LV V", "LV T", "V V", "V T", "LVT T", "T T"])


#: Letters from which an elision's apostrophe is not parted.
_VOWELS = frozenset("aàáâeèéêiìíîoòóôuùúû")


def _classes(prop: str, values: list[str]):
    @lru_cache(1 << 16)
    def of(c: str) -> str:
        return next((v for v in values if property_test(f"{prop}={v}", False)(c)), "")

    return of


cluster_class = _classes("Grapheme_Cluster_Break", _CLUSTER)
word_class = _classes("Word_Break", _WORD)
conjunct_class = _classes("Indic_Conjunct_Break", ["Consonant", "Linker", "Extend"])


@lru_cache(1 << 16)
def pictographic(c: str) -> bool:
    return property_test("Extended_Pictographic", False)(c)


def grapheme_end(text: str, i: int) -> int:
    """End of the extended grapheme cluster that begins at i."""
    a = cluster_class(text[i])
    flags, emoji, joined, conjunct = int(a == "Regional_Indicator"), pictographic(text[i]), False, conjunct_class(text[i])
    linked = False
    for j in range(i + 1, len(text)):
        c = text[j]
        b = cluster_class(c)
        if a == "CR" and b == "LF":
            return j + 1
        if a in ("CR", "LF", "Control") or b in ("CR", "LF", "Control"):
            return j
        kind = conjunct_class(c)
        if not (
            f"{a} {b}" in _JOINED
            or b in ("Extend", "ZWJ", "SpacingMark")
            or a == "Prepend"
            or (linked and kind == "Consonant")
            or (joined and pictographic(c))
            or (a == b == "Regional_Indicator" and flags % 2 == 1)
        ):
            return j
        flags = flags + 1 if b == "Regional_Indicator" else 0
        # A pictograph, what extends it and a joiner; a consonant and what extends it, with a linker.
        joined, emoji = emoji and b == "ZWJ", pictographic(c) or (emoji and b == "Extend")
        if kind == "Consonant":
            conjunct, linked = kind, False
        elif conjunct == "Consonant" and kind in ("Linker", "Extend"):
            linked = linked or kind == "Linker"
        else:
            conjunct, linked = "", False
        a = b
    return len(text)


def _before(text: str, i: int) -> int:
    """The place before i that is not skipped as part of what it follows, or -1."""
    i -= 1
    while i >= 0 and word_class(text[i]) in ("Extend", "Format", "ZWJ"):
        i -= 1
    return i


def default_boundary(text: str, i: int) -> bool:
    """Whether a default word boundary stands at i."""
    if not text:
        return False
    if i in (0, len(text)):
        return True
    a, b = word_class(text[i - 1]), word_class(text[i])
    if a == "CR" and b == "LF":
        return False
    if a in ("CR", "LF", "Newline") or b in ("CR", "LF", "Newline"):
        return True
    if (a == "ZWJ" and pictographic(text[i])) or a == b == "WSegSpace" or b in ("Extend", "Format", "ZWJ"):
        return False
    at = _before(text, i)
    if at < 0 or (text[at] in "'’" and text[i].lower()[0] in _VOWELS):
        return False
    a = word_class(text[at])
    if a == "Regional_Indicator":
        run = 0
        while at >= 0 and word_class(text[at]) == "Regional_Indicator":
            run, at = run + 1, at - 1
        return run % 2 == 0
    k, n = at - 1, i + 1
    far = word_class(text[k]) if k >= 0 else ""
    next_ = word_class(text[n]) if n < len(text) else ""
    letters = ("ALetter", "Hebrew_Letter")
    inner, digit = ("MidLetter", "MidNumLet", "Single_Quote"), ("MidNum", "MidNumLet", "Single_Quote")
    solid = (*letters, "Numeric", "Katakana")
    together = (
        (a in (*letters, "Numeric") and b in (*letters, "Numeric"))
        or (a in letters and b in inner and next_ in letters)
        or (far in letters and a in inner and b in letters)
        or (a == "Hebrew_Letter" and (b == "Single_Quote" or (b == "Double_Quote" and next_ == "Hebrew_Letter")))
        or (far == b == "Hebrew_Letter" and a == "Double_Quote")
        or (far == b == "Numeric" and a in digit)
        or (a == next_ == "Numeric" and b in digit)
        or a == b == "Katakana"
        or (a in (*solid, "ExtendNumLet") and b == "ExtendNumLet")
        or (a == "ExtendNumLet" and b in solid)
    )
    return not together

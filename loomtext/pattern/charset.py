"""Character sets: membership, set algebra and their spelling in Java's syntax."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

try:  # for the Unicode data of scripts, blocks and the rarer properties
    import regex
except ImportError:
    regex = None

#: Unicode white space, line ends, horizontal white space.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")
LINE_ENDS = frozenset("\n\x0b\x0c\r\x85  ")


#: Letters in circles and squares, which are alphabetic though symbols: fixed values.
_CIRCLED = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))


def is_alphabetic(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c) == "Nl" or any(a <= ord(c) <= z for a, z in _CIRCLED)


def is_word(c: str) -> bool:
    """Alphabetic, mark, decimal digit, connector punctuation or join control."""
    return is_alphabetic(c) or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Pc") or c in "\u200c\u200d"


#: Predicates by normalised name, with the Java class that says the same, if there is one.
_BINARY = {
    "alpha": (is_alphabetic, r"\p{IsAlphabetic}"),
    "alphabetic": (is_alphabetic, r"\p{IsAlphabetic}"),
    "alnum": (lambda c: is_alphabetic(c) or unicodedata.category(c) == "Nd", r"[\p{IsAlphabetic}\p{Nd}]"),
    "alphanumeric": (lambda c: is_alphabetic(c) or unicodedata.category(c) == "Nd", r"[\p{IsAlphabetic}\p{Nd}]"),
    "digit": (lambda c: unicodedata.category(c) == "Nd", r"\p{Nd}"),
    "word": (is_word, r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}‌‍]"),
    "space": (lambda c: c in WHITE, r"\p{IsWhite_Space}"),
    "whitespace": (lambda c: c in WHITE, r"\p{IsWhite_Space}"),
    "horizspace": (lambda c: c == "\t" or unicodedata.category(c) == "Zs", r"[\t\p{Zs}]"),
    "blank": (lambda c: c == "\t" or unicodedata.category(c) == "Zs", r"[\t\p{Zs}]"),
    "lower": (lambda c: c.islower(), r"\p{IsLowercase}"),
    "lowercase": (lambda c: c.islower(), r"\p{IsLowercase}"),
    "upper": (lambda c: c.isupper(), r"\p{IsUppercase}"),
    "uppercase": (lambda c: c.isupper(), r"\p{IsUppercase}"),
    "punct": (lambda c: unicodedata.category(c)[0] == "P", r"\p{P}"),
    "cntrl": (lambda c: unicodedata.category(c) == "Cc", r"\p{Cc}"),
    "xdigit": (lambda c: c in "0123456789abcdefABCDEF", "[0-9a-fA-F]"),
    "graph": (lambda c: c not in WHITE and unicodedata.category(c) not in ("Cc", "Cs", "Cn"), None),
    "print": (lambda c: unicodedata.category(c) not in ("Cc", "Cs", "Cn", "Zl", "Zp"), None),
    "any": (lambda c: True, r"[\x{0}-\x{10FFFF}]"),
    "ascii": (lambda c: c < "\x80", r"[\x00-\x7F]"),
    "assigned": (lambda c: unicodedata.category(c) != "Cn", None),
}
_ASCII_ONLY = {
    "alpha": "[A-Za-z]", "alnum": "[0-9A-Za-z]", "digit": "[0-9]", "word": "[0-9A-Za-z_]", "space": r"[\t-\r ]", "lower": "[a-z]", "upper": "[A-Z]", "horizspace": r"[\t ]", "blank": r"[\t ]",
}
#: What Java's escapes mean under (?U), where it tests them faster than any class that says the same.
_UNICODE_ESCAPE = {"word": r"\w", "digit": r"\d", "space": r"\s", "whitespace": r"\s"}
_CATEGORIES = frozenset("C L M N P S Z Cc Cf Cn Co Cs Ll Lm Lo Lt Lu Mc Me Mn Nd Nl No Pc Pd Pe Pf Pi Po Ps Sc Sk Sm So Zl Zp Zs LC".split())
_LONG = {
    "letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt",
    "modifierletter": "Lm", "otherletter": "Lo", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "control": "Cc", "format": "Cf", "currencysymbol": "Sc", "mathsymbol": "Sm",
    "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "spaceseparator": "Zs", "casedletter": "LC", "unassigned": "Cn",
}
def normal(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def fold(c: str) -> str:
    """Simple case folding of one character, without the Turkic pairs."""
    if c in "İı":
        return c
    f = c.casefold()
    return f if len(f) == 1 else c.lower() if len(c.lower()) == 1 else c


@lru_cache(4096)
def cases(c: str) -> frozenset[str]:
    """All characters with the same simple folding."""
    f = fold(c)
    out = {c, f}
    for x in (c, f):
        for y in (x.lower(), x.upper(), x.title()):
            if len(y) == 1 and fold(y) == f:
                out.add(y)
    out |= {x for x in _ODD.get(f, ()) if fold(x) == f}
    return frozenset(out)


#: Characters that fold to a letter but are not found from it by upper() or lower(): fixed values.
_ODD = {"k": "K", "s": "ſ", "\xe5": "Å", "σ": "ς", "θ": "ϑϴ", "β": "ϐ", "φ": "ϕ", "π": "ϖ", "κ": "ϰ", "ρ": "ϱ", "ε": "ϵ", "μ": "\xb5", "ω": "Ω"}


@dataclass(frozen=True)
class Set:
    """kind: range (a, b), prop (name, ascii), union, inter, diff, sym (members), each perhaps negated."""

    kind: str
    args: tuple
    negated: bool = False
    icase: bool = False

    def invert(self) -> Set:
        return Set(self.kind, self.args, not self.negated, self.icase)

    def fold(self) -> Set:
        return Set(self.kind, tuple(a.fold() if isinstance(a, Set) else a for a in self.args), self.negated, True)

    def _own(self, c: str) -> bool:
        if self.kind == "range":
            return self.args[0] <= c <= self.args[1]
        if self.kind == "prop":
            return property_test(*self.args)(c)
        if self.kind == "union":
            return any(c in m for m in self.args)
        if self.kind == "inter":
            return all(c in m for m in self.args)
        if self.kind == "diff":
            return c in self.args[0] and not any(c in m for m in self.args[1:])
        return sum(c in m for m in self.args) % 2 == 1

    def __contains__(self, c: str) -> bool:
        if self.icase and self.kind in ("range", "prop"):
            hit = any(self._own(x) for x in cases(c))
        else:
            hit = self._own(c)
        return hit != self.negated

    def java(self) -> str | None:
        """A Java character class, or None if there is none that says the same."""
        if self.kind == "range":
            a, b = self.args
            if self.icase:
                if ord(b) - ord(a) > 300:
                    return None
                own = sorted({x for k in range(ord(a), ord(b) + 1) for x in cases(chr(k))})
                body = "".join(java_char(x) for x in own)
            else:
                body = java_char(a) if a == b else f"{java_char(a)}-{java_char(b)}"
            return f"[{'^' if self.negated else ''}{body}]"
        if self.kind == "prop":
            name, ascii_ = self.args
            own = java_property(name, ascii_)
            if own is None or (self.icase and normal(name) in ("lu", "ll", "lt", "lower", "upper", "lowercase", "uppercase", "uppercaseletter", "lowercaseletter")):
                return None
            return f"[{'^' if self.negated else ''}{own}]"
        parts = [m.java() for m in self.args]
        if None in parts:
            return None
        if self.kind == "union":
            body = "".join(parts)
        elif self.kind == "inter":
            body = "&&".join(parts)
        elif self.kind == "diff":
            body = "&&".join([parts[0], *(f"[^{p}]" for p in parts[1:])])
        else:
            body = parts[0]
            for p in parts[1:]:
                body = f"[{body}&&[^{p}]][{p}&&[^{body}]]"
        # A negation binds to the whole class: Java would negate only the first operand of an intersection.
        return f"[^[{body}]]" if self.negated else f"[{body}]"


def java_char(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def union(*members: Set) -> Set:
    return members[0] if len(members) == 1 else Set("union", members)


def one(c: str) -> Set:
    return Set("range", (c, c))


@lru_cache(1024)
def property_test(name: str, ascii_: bool):
    """Membership test of a property; raises KeyError for an unknown one."""
    key, _, value = name.partition("=") if "=" in name else name.partition(":")
    own = normal(value or key)
    kind = normal(key) if value else ""
    if kind in _BINARY and own in ("y", "yes", "t", "true", "n", "no", "f", "false"):
        inner = property_test(key, ascii_)
        return inner if own in ("y", "yes", "t", "true") else lambda c: not inner(c)
    if own in _BINARY and kind in ("", "gc"):
        test = _BINARY[own][0]
        return (lambda c: c < "\x80" and test(c)) if ascii_ and own in _ASCII_ONLY else test
    category = _LONG.get(own) or next((g for g in _CATEGORIES if g.lower() == own), None)
    if category and kind in ("", "gc", "generalcategory"):
        if category == "LC":
            return lambda c: unicodedata.category(c) in ("Lu", "Ll", "Lt")
        return lambda c: unicodedata.category(c).startswith(category)
    return Known(name)


class Known:
    """Membership by the Unicode data of the regex package: any property, script or block. KeyError, with the reason, if there is none of the name."""

    def __init__(self, name: str) -> None:
        self.name = name
        try:
            if regex is None or not re.fullmatch(r"[\w\s&.:=/+-]+", name):
                raise KeyError("unknown property")
            self.match = regex.compile(self.pattern(), regex.V1).match
        except regex.error as e:
            raise KeyError(e.msg) from None

    def pattern(self) -> str:
        return rf"\p{{{self.name}}}"

    def __call__(self, c: str) -> bool:
        return self.match(c) is not None

    def java(self, most: int = 400) -> str | None:
        """Its characters spelled out, so that Java has the same; None if they are in too many pieces."""
        every = _every()
        runs = [m.span() for m in regex.finditer(self.pattern() + "+", every, regex.V1)]
        if not runs or len(runs) > most:
            return None
        return "".join(java_char(every[a]) if z == a + 1 else f"{java_char(every[a])}-{java_char(every[z - 1])}" for a, z in runs)


@lru_cache(1)
def _every() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))


def java_property(name: str, ascii_: bool) -> str | None:
    own = normal(name.rpartition("=")[2] if "=" in name else name)
    if ascii_ and own in _ASCII_ONLY:
        return _ASCII_ONLY[own]
    if "=" in name or ":" in name:
        return _spelled(name)
    if own in _UNICODE_ESCAPE:
        return _UNICODE_ESCAPE[own]
    if own in _BINARY:
        whole = _BINARY[own][1]
        # ASCII first: Java tests it in a bit table, and only what is beyond it against properties.
        return f"{_ASCII_ONLY[own][1:-1]}[[^\\x{{0}}-\\x{{7F}}]&&[{whole}]]" if own in _ASCII_ONLY and whole else whole
    category = _LONG.get(own) or next((g for g in _CATEGORIES if g.lower() == own), None)
    if category and category != "LC":
        return rf"\p{{{category}}}"
    return _spelled(name)


@lru_cache(256)
def _spelled(name: str) -> str | None:
    """For Java, a property that is read from the Unicode data as a whole."""
    test = property_test(name, False)
    return test.java() if isinstance(test, Known) else None

"""Patterns as Java regular expressions, where Java can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import combinations
from math import comb

from . import nodes as N
from .charset import LINE_ENDS, Set, cases, java_char, java_property
from .engine import Pattern
from .flags import Flag
from .matcher import expansions, full_fold, fuzzy_words, may_expand

_META = frozenset("\\^$.|?*+()[]{}-&~#<>=!:, \t\n\r\x0b\x0c")
_ENDS = "[" + "".join(map(java_char, sorted(LINE_ENDS))) + "]"
#: Places at which the WORD flag takes every line end; no line ends or begins inside a carriage return with its line feed.
_INSIDE = "(?!(?<=\\x{D})\\x{A})"
WIDE = {"line_start": f"(?:\\A|(?<={_ENDS}){_INSIDE})", "line_end": f"(?:\\z|{_INSIDE}(?={_ENDS}))", "end_line": f"(?=(?:\\x{{D}}\\x{{A}}|{_ENDS})?\\z)"}


class NotJava(Exception):
    """Why a pattern has no Java form."""


def quote(s: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c if c.isalnum() or c in " _-,;:/@'\"<>=!%&~#" else java_char(c) for c in s)


def java(pattern: Pattern) -> str:
    """The Java form of a pattern; raises NotJava with the reason if there is none.

    Classes are spelled out, letters without case become sets, and a repeat without bound must have a body that cannot exhaust the stack:
    Java recurses once a pass over groups, alternatives and bodies of changing width."""
    parsed = pattern.parsed
    flags = parsed.flags
    for flag in (Flag.REVERSE, Flag.POSIX, Flag.LOCALE):
        if flags & flag:
            raise NotJava(f"{flag.name} has no Java form")
    numbers = [n.number for n in N.walk(parsed.root) if isinstance(n, N.Group)]
    if sorted(numbers) != list(range(1, len(numbers) + 1)):
        raise NotJava("groups that share a number")
    return _classed(_java(parsed.root, False))


def _classed(body: str) -> str:
    return f"(?U){body}" if any(e in body for e in (r"\w", r"\d", r"\s")) else body


def _risky(n: N.Node) -> bool:
    """Whether a body makes an unbounded repeat recurse in Java."""
    low, high = N.width(n)
    return low != high or any(isinstance(c, (N.Alt, N.Group, N.Look, N.Back, N.Repeat)) for c in N.walk(n))


def _java(n: N.Node, atomic: bool) -> str:
    if isinstance(n, N.Text):
        if not n.folded:
            return quote(n.chars)
        if n.full:
            return _folded(full_fold(n.chars))
        return "".join(quote(c) if len(cases(c)) == 1 else "[" + "".join(java_char(x) for x in sorted(cases(c))) + "]" for c in n.chars)
    if isinstance(n, N.Cls):
        if n.dot is not None:
            return "[\\x{0}-\\x{10FFFF}]" if not n.dot else "[^" + "".join(java_char(c) for c in n.dot) + "]"
        own = n.chars.java()
        if own is None:
            raise NotJava("a set that Java cannot spell")
        return own
    if isinstance(n, N.Seq):
        return "".join(_wrapped(c, atomic) if isinstance(c, N.Alt) else _java(c, atomic) for c in n.items)
    if isinstance(n, N.Alt):
        return "|".join(_java(c, atomic) for c in n.items)
    if isinstance(n, N.Group):
        return f"({_java(n.body, atomic)})"
    if isinstance(n, N.Atomic):
        return f"(?>{_java(n.body, atomic)})"
    if isinstance(n, N.Repeat):
        if n.high is None and n.how != "possessive" and _risky(n.body):
            raise NotJava("an unbounded repeat whose body could exhaust Java's stack")
        if n.high is None and n.how == "possessive" and any(isinstance(c, N.Group) for c in N.walk(n.body)):
            raise NotJava("an unbounded repeat of groups")
        body = _java(n.body, atomic)
        if not (isinstance(n.body, (N.Cls, N.Group, N.Atomic)) or (isinstance(n.body, N.Text) and len(n.body.chars) == 1 and not n.body.folded)):
            body = f"(?:{body})"
        high = "" if n.high is None else n.high
        times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((n.low, n.high), f"{{{n.low},{high}}}")
        return body + times + {"greedy": "", "lazy": "?", "possessive": "+"}[n.how]
    if isinstance(n, N.Look):
        if n.behind:
            low, high = N.width(n.body)
            if low != high:
                raise NotJava("lookbehind of changing width")
        return f"(?{'<' if n.behind else ''}{'!' if n.negated else '='}{_java(n.body, atomic)})"
    if isinstance(n, N.Back):
        if n.folded:
            raise NotJava("a backreference without case")
        return f"(?:\\{n.group})"
    if isinstance(n, N.Verb) and n.kind == "fail":
        return "(?!)"
    if isinstance(n, N.Names):
        if n.folded:
            return "(?:" + "|".join(_java(N.Text(w, True, n.full), atomic) for w in n.words) + ")" if n.words else "(?!)"
        return "(?:" + "|".join(quote(w) for w in n.words) + ")" if n.words else "(?!)"
    if isinstance(n, N.Define):
        return ""
    if isinstance(n, N.At):
        if n.wide and n.kind in WIDE:
            return WIDE[n.kind]
        if n.wide and n.kind in ("word", "not_word", "word_start", "word_end"):
            raise NotJava("default word boundaries have no Java form")
        word = f"[{java_property('word', n.ascii).strip('[]') if n.ascii else java_property('word', False)}]"
        before, after = f"(?<={word})", f"(?={word})"
        no_before, no_after = f"(?<!{word})", f"(?!{word})"
        places = {
            "start": "\\A", "end": "\\z", "end_line": "(?=\\x{A}?\\z)", "line_start": "(?:\\A|(?<=\\x{A}))", "line_end": "(?=\\x{A}|\\z)",
            "word": f"(?:{before}{no_after}|{no_before}{after})", "not_word": f"(?:{before}{after}|{no_before}{no_after})", "word_start": no_before + after, "word_end": before + no_after,
        }
        if n.kind in places:
            return places[n.kind]
    if isinstance(n, N.Fuzzy) and n.budget.exact and not atomic:
        return _wrapped(n.body, atomic)
    raise NotJava(f"{type(n).__name__} has no Java form")


def _wrapped(n: N.Node, atomic: bool) -> str:
    return f"(?:{_java(n, atomic)})"


def _folded(text: str) -> str:
    """A pattern of all spellings of a folded text, characters that fold to several included."""
    options = {k: [f for f in expansions() if text.startswith(f, k)] for k in range(len(text))}
    one = lambda c: quote(c) if len(cases(c)) == 1 else "[" + "".join(java_char(x) for x in sorted(cases(c))) + "]"

    def ways(k: int, end: int) -> str:
        """Spellings of a stretch over whose places a character of several may lie."""
        if k >= end:
            return ""
        own = [one(text[k]) + ways(k + 1, end)]
        own += ["[" + "".join(java_char(x) for x in expansions()[f]) + "]" + ways(k + len(f), end) for f in options[k]]
        return own[0] if len(own) == 1 else "(?:" + "|".join(own) + ")"

    out, k = [], 0
    while k < len(text):
        if not options[k]:
            out.append(one(text[k]))
            k += 1
            continue
        end, at = k + 1, k
        while at < end:
            end = max([end, *(at + len(f) for f in options[at])])
            at += 1
        if end - k > 8:
            raise NotJava("a long stretch of letters that fold together")
        out.append(ways(k, end))
        k = end
    return "".join(out)


#: Characters of a Java pattern beyond which a fuzzy text is left to the matcher.
MOST_NEAR = 400_000


class _Near:
    """Java patterns of a text with up to some errors, written out: at each character it is as it should be, another, missing, or behind one more."""

    def __init__(self, chars: str, folded: bool):
        self.chars, self.folded = chars, folded
        self.size: dict[tuple[int, int, int], int] = {}

    def one(self, k: int) -> str:
        c = self.chars[k]
        return "[" + "".join(java_char(x) for x in sorted(cases(c))) + "]" if self.folded and len(cases(c)) > 1 else quote(c)

    def several(self, k: int, end: int) -> list[tuple[str, int]]:
        """Characters that stand for several from place k on, with the place behind these."""
        own = [f for f in expansions() if self.chars.startswith(f, k) and k + len(f) <= end] if self.folded else []
        return [("[" + "".join(java_char(x) for x in expansions()[f]) + "]", k + len(f)) for f in own]

    def length(self, k: int, end: int, errors: int) -> int:
        """About how long within() is."""
        if k >= end:
            return 0
        if (k, end, errors) not in self.size:
            own = 8 + self.length(k + 1, end, errors) + sum(12 + self.length(z, end, errors) for _, z in self.several(k, end))
            if errors:
                own += 10 + self.length(k + 1, end, errors - 1) + self.length(k, end, errors - 1)
            self.size[k, end, errors] = own
        return self.size[k, end, errors]

    def within(self, k: int, end: int, errors: int) -> str:
        if k >= end:
            return ""
        own = [self.one(k) + self.within(k + 1, end, errors), *(c + self.within(z, end, errors) for c, z in self.several(k, end))]
        if errors:
            own += [".?" + self.within(k + 1, end, errors - 1), "." + self.within(k, end, errors - 1)]
        return own[0] if len(own) == 1 else "(?:" + "|".join(own) + ")"


def near(p: Pattern) -> tuple[str, str, str]:
    """For a pattern of fuzzy texts that match by their distance alone: a Java pattern that finds them, one for the texts that it cannot be
    used on, and one that finds them there.

    With e errors one of e + 1 pieces of a text is unchanged. A piece is looked for, and only where it is the rest is compared, to
    the left by a lookbehind. A character that stands for two letters may lie over the border of two pieces, and a lookbehind counts one
    above U+FFFF for two: texts with such characters are compared from every place on. Raises NotJava."""
    words = fuzzy_words(p.parsed.root)
    if not words or not all(w[3] for w in words) or p.steps is not None or p.seconds is not None:
        raise NotJava("more than the distance decides")
    anchored, whole, room = [], [], MOST_NEAR
    for chars, folded, most, _ in words:
        own, n = _Near(chars, folded), len(chars)
        room -= own.length(0, n, most) * (most + 2)
        if room < 0 or most > 4:
            raise NotJava("a fuzzy text that is too long to be written out")
        cuts = [n * k // (most + 1) for k in range(most + 2)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            piece = "".join(own.one(k) for k in range(a, z))
            splits = [0] if a == 0 else [most] if z == n else range(most + 1)
            anchored.append(piece + "(?:" + "|".join((f"(?<={own.within(0, a, e)}{piece})" if a else "") + own.within(z, n, most - e) for e in splits) + ")")
        whole.append(own.within(0, n, most))
    wide = "".join(sorted(set("".join(may_expand(w[0]) for w in words if w[1]))))
    return f"(?s)(?:{'|'.join(anchored)})", f"[{''.join(map(java_char, wide))}\\x{{10000}}-\\x{{10FFFF}}]", f"(?s)(?:{'|'.join(whole)})"


#: Ways to place the substitutions of a backreference beyond which it is left to the matcher.
MOST_WAYS = 64


def echo(p: Pattern) -> str:
    """A Java pattern that tests for a match of one whose only fuzzy parts are backreferences with substitutions.

    Each character of the group becomes a group of its own, and the reference a choice of those that may differ. Groups are numbered anew,
    so it is for tests alone. Raises NotJava."""
    parsed = p.parsed
    if parsed.flags & (Flag.REVERSE | Flag.POSIX | Flag.LOCALE) or p.steps is not None or p.seconds is not None:
        raise NotJava("more than a test without budgets")
    groups = [n for n in N.walk(parsed.root) if isinstance(n, N.Group)]
    if [n.number for n in groups] != list(range(1, len(groups) + 1)):
        raise NotJava("groups that share a number")
    inner = {c.number for n in N.walk(parsed.root) if isinstance(n, (N.Repeat, N.Look, N.Atomic, N.Define, N.Fuzzy)) for c in N.walk(n) if isinstance(c, N.Group)}
    echoes = {id(n): _echo(n) for n in N.walk(parsed.root) if isinstance(n, N.Fuzzy)}
    if not echoes or any(isinstance(c, N.Fuzzy) for n in N.walk(parsed.root) if isinstance(n, N.Fuzzy) for c in N.walk(n.body)):
        raise NotJava("no fuzzy backreference, or one inside a fuzzy part")
    split = {}
    for g, most in echoes.values():
        chars = _characters(groups[g - 1].body)
        if g in inner or most >= len(chars) or comb(len(chars), most) > MOST_WAYS:
            raise NotJava("a group that is repeated, as short as its errors, or too long to be written out")
        split[g] = chars
    number, last = {}, 0
    for n in groups:
        number[n.number] = last = last + 1
        last += len(split.get(n.number, ()))

    def own(n: N.Node) -> N.Node | None:
        if isinstance(n, N.Back):
            return N.Back(number[n.group], n.folded, n.full)
        if isinstance(n, N.Group) and n.number in split:
            return N.Group(N.Seq([N.Group(c, 0) for c in split[n.number]]), 0)
        if isinstance(n, N.Fuzzy):
            g, most = echoes[id(n)]
            size = len(split[g])
            return N.Alt([N.Seq([ANY if k in gone else N.Back(number[g] + 1 + k) for k in range(size)]) for gone in combinations(range(size), most)])
        return None

    return _classed(_java(_mapped(parsed.root, own), False))


ANY = N.Cls(Set("prop", ("any", False)), dot="")


def _echo(n: N.Fuzzy) -> tuple[int, int]:
    """The group of a fuzzy backreference and its most substitutions."""
    b, body = n.budget, n.body
    while isinstance(body, N.Seq) and len(body.items) == 1:
        body = body.items[0]
    limits = [k for k in (b.high["s"], b.high["e"]) if k is not None]
    if not isinstance(body, N.Back) or body.folded or b.weights is not None or b.test is not None or b.low or b.high["i"] != 0 or b.high["d"] != 0 or not limits:
        raise NotJava("more than substitutions in a backreference")
    return body.group, min(limits)


def _characters(n: N.Node) -> list[N.Node]:
    """The nodes of a part that are one character each."""
    if isinstance(n, N.Cls):
        return [n]
    if isinstance(n, N.Text) and not n.full:
        return [N.Text(c, n.folded) for c in n.chars]
    if isinstance(n, N.Seq):
        return [c for own in n.items for c in _characters(own)]
    if isinstance(n, N.Repeat) and n.low == n.high and n.low <= MOST_WAYS:
        return _characters(n.body) * n.low
    raise NotJava("a group of changing width")


def _mapped(n: N.Node, own: Callable[[N.Node], N.Node | None]) -> N.Node:
    """A copy in which `own` gives some nodes anew."""
    new = own(n)
    if new is not None:
        return new
    if isinstance(n, (N.Seq, N.Alt)):
        return type(n)([_mapped(c, own) for c in n.items])
    if isinstance(n, (N.Repeat, N.Group, N.Atomic, N.Look)):
        return replace(n, body=_mapped(n.body, own))
    if N.children(n):
        raise NotJava(f"{type(n).__name__} beside a fuzzy backreference")
    return n


def template(pattern: Pattern, text: str) -> str:
    """A replacement template in Java's spelling."""
    out = []
    for part in pattern.template(text):
        out.append(f"${part}" if isinstance(part, int) else part.replace("\\", "\\\\").replace("$", "\\$"))
    # $1 followed by a digit would be read as another group.
    for a, b in zip(out, out[1:], strict=False):
        if a.startswith("$") and a[1:].isdigit() and b[:1].isdigit():
            raise NotJava("a group before a digit")
    return "".join(out)


def scans_alike(pattern: Pattern) -> bool:
    """Whether Java's loop over matches steps as ours does: no match may be empty."""
    return N.width(pattern.parsed.root)[0] > 0


def all_take_part(pattern: Pattern) -> bool:
    """Whether every group takes part in every match, so that Java's empty text for an absent group cannot come up."""
    def needed(n: N.Node) -> set[int]:
        if isinstance(n, N.Group):
            return {n.number} | needed(n.body)
        if isinstance(n, N.Seq):
            return set().union(*(needed(c) for c in n.items)) if n.items else set()
        if isinstance(n, N.Alt):
            return set.intersection(*(needed(c) for c in n.items)) if n.items else set()
        if isinstance(n, N.Atomic):
            return needed(n.body)
        if isinstance(n, N.Repeat) and n.low:
            return needed(n.body)
        return set()

    return needed(pattern.parsed.root) == set(range(1, pattern.group_count + 1))


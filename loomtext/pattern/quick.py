"""Texts of Latin-1 characters, for which a pattern's sets can be written out and Python's own matcher gives the same answers."""

from __future__ import annotations

import re

from . import nodes as N
from .charset import Set, cases, one, union
from .flags import Flag
from .matcher import full_fold
from .parser import Parsed


#: Places at which the WORD flag takes every line end, of those in Latin-1; no line ends or begins inside a carriage return with its line feed.
_INSIDE = r"(?!(?<=\r)\n)"
_WIDE = {"line_start": rf"(?:\A|(?<=[\n\x0b\x0c\r\x85]){_INSIDE})", "line_end": rf"(?:\Z|{_INSIDE}(?=[\n\x0b\x0c\r\x85]))", "end_line": r"(?=(?:\r\n|[\n\x0b\x0c\r\x85])?\Z)"}


class _No(Exception):
    pass


def quick(parsed: Parsed) -> re.Pattern | None:
    """A pattern of Python's re that matches Latin-1 texts as this one does, or None.

    Taken are constructs of one meaning in both; repeats without bound must have a body of one way to match, as re has no budget to stop a
    search that explodes, and passes of repeats must consume something, as empty passes differ."""
    if parsed.flags & (Flag.REVERSE | Flag.POSIX | Flag.LOCALE):
        return None
    numbers = [n.number for n in N.walk(parsed.root) if isinstance(n, N.Group)]
    if numbers != list(range(1, len(numbers) + 1)):
        return None
    try:
        return re.compile(_emit(parsed.root))
    except (_No, re.error):
        return None


def single_captures(parsed: Parsed) -> bool:
    """Whether no group can capture twice in one match."""
    return not any(isinstance(n, N.Repeat) and n.high != 1 and any(isinstance(c, N.Group) for c in N.walk(n.body)) for n in N.walk(parsed.root))


def _set(s: Set) -> str:
    own = [k for k in range(256) if chr(k) in s]
    if not own:
        return "(?!)"
    parts, first = [], own[0]
    for a, b in zip(own, [*own[1:], None], strict=True):
        if b != a + 1:
            parts.append(f"\\x{first:02x}" if first == a else f"\\x{first:02x}-\\x{a:02x}")
            first = b
    return "[" + "".join(parts) + "]"


def _char(c: str, folded: bool) -> str:
    return _set(union(*map(one, sorted(cases(c))))) if folded else re.escape(c)


def _emit(n: N.Node) -> str:
    if isinstance(n, N.Text):
        if n.full and ("ss" in full_fold(n.chars) or len(full_fold(n.chars)) != len(n.chars)):
            raise _No  # one character may stand for several
        return "".join(_char(c, n.folded) for c in n.chars)
    if isinstance(n, N.Cls):
        return _set(n.chars)
    if isinstance(n, N.Seq):
        return "".join(f"(?:{_emit(c)})" if isinstance(c, N.Alt) else _emit(c) for c in n.items)
    if isinstance(n, N.Alt):
        return "|".join(map(_emit, n.items))
    if isinstance(n, N.Group):
        return f"({_emit(n.body)})"
    if isinstance(n, N.Atomic):
        return f"(?>{_emit(n.body)})"
    if isinstance(n, N.Repeat):
        low, high = N.width(n.body)
        if low == 0 or ((n.high is None or n.high > 8) and (low != high or any(isinstance(c, (N.Alt, N.Group, N.Look, N.Back, N.Repeat)) for c in N.walk(n.body)))):
            raise _No
        return f"(?:{_emit(n.body)}){{{n.low},{'' if n.high is None else n.high}}}" + {"greedy": "", "lazy": "?", "possessive": "+"}[n.how]
    if isinstance(n, N.Look):
        low, high = N.width(n.body)
        if n.behind and low != high:
            raise _No
        return f"(?{'<' if n.behind else ''}{'!' if n.negated else '='}{_emit(n.body)})"
    if isinstance(n, N.Back) and not n.folded:
        return f"(?:\\{n.group})"
    if isinstance(n, N.Cond) and not isinstance(n.test, N.Look):
        return f"(?({n.test}){_alone(n.yes)}|{_alone(n.no)})"
    if isinstance(n, N.Names):
        if not n.words:
            return "(?!)"
        return "(?:" + "|".join(_emit(N.Text(w, n.folded, n.full)) for w in n.words) + ")"
    if isinstance(n, N.Verb) and n.kind == "fail":
        return "(?!)"
    if isinstance(n, N.At) and n.wide and n.kind in _WIDE:
        return _WIDE[n.kind]
    if isinstance(n, N.At) and not (n.wide and n.kind in ("word", "not_word", "word_start", "word_end")):
        word = _set(Set("prop", ("word", n.ascii)))
        before, after, no_before, no_after = f"(?<={word})", f"(?={word})", f"(?<!{word})", f"(?!{word})"
        places = {
            "start": r"\A", "end": r"\Z", "end_line": r"(?=\n?\Z)", "line_start": r"(?:\A|(?<=\n))", "line_end": r"(?=\n|\Z)",
            "word": f"(?:{before}{no_after}|{no_before}{after})", "not_word": f"(?:{before}{after}|{no_before}{no_after})", "word_start": no_before + after, "word_end": before + no_after,
        }
        if n.kind in places:
            return places[n.kind]
    raise _No


def _alone(n: N.Node) -> str:
    return f"(?:{_emit(n)})"


def fits(text: str) -> bool:
    """Whether a text has Latin-1 characters only."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True

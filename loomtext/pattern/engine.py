"""The compiled pattern: what one text and one pattern give."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

from . import nodes as N
from .errors import PatternError
from .flags import Flag
from .matcher import Found, Machine
from .nodes import weight
from .parser import Parsed, parse
from .quick import fits, quick, single_captures

#: Characters that escape() puts a backslash before: fixed values.
SPECIAL = frozenset("()[]{}?*+|^$\\.-#&~")


@dataclass(frozen=True)
class Span:
    index: int
    length: int
    value: str


class Match:
    """One match of one text."""

    def __init__(self, pattern: Pattern, text: str, found: Found, resume: Callable[[], Match | None] | None = None):
        self.pattern, self.text, self.found, self._resume = pattern, text, found, resume

    @property
    def index(self) -> int:
        return self.found.start

    @property
    def length(self) -> int:
        return self.found.end - self.found.start

    @property
    def end(self) -> int:
        return self.found.end

    @property
    def value(self) -> str:
        return self.text[self.found.start : self.found.end]

    @property
    def partial(self) -> bool:
        return self.found.partial

    @property
    def fuzzy_counts(self) -> tuple[int, int, int]:
        """Substitutions, insertions, deletions."""
        return self.found.counts

    @property
    def fuzzy_changes(self) -> tuple[list[int], list[int], list[int]]:
        return self.found.changes()

    @property
    def last_group(self) -> int:
        return self.found.last

    @property
    def last_group_name(self) -> str | None:
        return self.pattern.name_of(self.found.last)

    def number(self, group: int | str) -> int:
        n = self.pattern.group_numbers.get(group, group) if isinstance(group, str) else group
        if isinstance(n, str):
            if not n.isdigit():
                raise IndexError(f"no such group: {group}")
            n = int(n)
        if not 0 <= n < len(self.found.captures):
            raise IndexError(f"no such group: {group}")
        return n

    def captures(self, group: int | str = 0) -> list[Span]:
        """Every capture of a group, oldest first."""
        return [Span(a, b - a, self.text[a:b]) for a, b in self.found.captures[self.number(group)]]

    def group(self, group: int | str = 0) -> str | None:
        """A group's last capture, None if it took no part."""
        own = self.found.captures[self.number(group)]
        return self.text[own[-1][0] : own[-1][1]] if own else None

    def groups(self) -> list[str | None]:
        return [self.group(g) for g in range(1, len(self.found.captures))]

    def span(self, group: int | str = 0) -> tuple[int, int]:
        own = self.found.captures[self.number(group)]
        return own[-1] if own else (-1, -1)

    def next_match(self) -> Match | None:
        return self._resume() if self._resume else None

    def expand(self, template: str) -> str:
        """A replacement template filled in from this match."""
        return "".join(p if isinstance(p, str) else self.group(p) or "" for p in self.pattern.template(template))

    def expand_format(self, template: str) -> str:
        """A format template: {} {1} {name} {1[-1]}."""
        out = []
        for part in self.pattern.format_template(template):
            if isinstance(part, str):
                out.append(part)
                continue
            group, capture = part
            own = self.captures(group)
            if capture is None:
                out.append(own[-1].value if own else "")
            else:
                try:
                    out.append(own[capture].value)
                except IndexError:
                    if own or capture not in (0, -1):
                        raise
                    out.append("")
        return "".join(out)


#: Nodes that a pattern may have unless the caller allows more.
MAX_NODES = 1_000_000


class Pattern:
    """A pattern with its options, named lists, and budgets of steps and seconds for one call; it can be pickled and is cached by worker."""

    def __init__(self, pattern: str, flags: Flag = Flag.NONE, lists: Mapping[str, Iterable[str]] | None = None, *, steps: int | None = None, seconds: float | None = None, on_timeout: str = "error", max_nodes: int = MAX_NODES):
        if max_nodes < 1:
            raise ValueError("max_nodes is positive")
        if on_timeout not in ("error", "null"):
            raise ValueError("on_timeout is error or null")
        self.pattern, self.given, self.steps, self.seconds, self.on_timeout = pattern, Flag(flags), steps, seconds, on_timeout
        self.lists = {k: tuple(v) for k, v in (lists or {}).items()}
        self.max_nodes = max_nodes
        deep = sys.getrecursionlimit()
        sys.setrecursionlimit(max(deep, 50_000))  # some frames for each of the nested groups that the parser allows
        try:
            self.parsed: Parsed = parse(pattern, self.given, self.lists)
            heavy = weight(self.parsed.root) > max_nodes
        except RecursionError:
            raise PatternError("pattern nested too deeply", pattern) from None
        finally:
            sys.setrecursionlimit(deep)
        if heavy:
            raise PatternError(f"the pattern needs more than {max_nodes} nodes, with counted repeats written out; allow more by max_nodes or reduce the counts", pattern)
        self.machine = Machine(self.parsed, steps, seconds)
        # Budgets are the machine's alone; repeated captures are too.
        self.quick = quick(self.parsed) if steps is None and seconds is None else None
        self.quick_records = self.quick if self.quick and single_captures(self.parsed) else None

    def __reduce__(self):
        return compile, (self.pattern, self.given, tuple((k, v) for k, v in self.lists.items()), self.steps, self.seconds, self.on_timeout, self.max_nodes)

    # --- what the pattern is ----------------------------------------------------------------------------------------

    @property
    def flags(self) -> Flag:
        return self.parsed.flags

    @property
    def group_count(self) -> int:
        return self.parsed.groups

    @property
    def group_numbers(self) -> dict[str, int]:
        return self.parsed.names

    @property
    def group_names(self) -> list[str]:
        return [self.name_of(g) or str(g) for g in range(self.parsed.groups + 1)]

    @property
    def named_lists(self) -> dict[str, frozenset[str]]:
        return {k: frozenset(v) for k, v in self.lists.items()}

    def name_of(self, group: int) -> str | None:
        return next((k for k, v in self.parsed.names.items() if v == group), None)

    @property
    def reverse(self) -> bool:
        return bool(self.flags & Flag.REVERSE)

    # --- matching ---------------------------------------------------------------------------------------------------

    @staticmethod
    def slice(text: str, beginning: int, length: int) -> tuple[int, int]:
        """Begin and end of a slice; a negative beginning counts from the end, and what is out of range is clamped."""
        n = len(text)
        begin = max(0, n + beginning) if beginning < 0 else min(beginning, n)
        return begin, n if length < 0 else min(n, begin + length)

    def _find(self, text: str, beginning: int = 0, length: int = -1, **how) -> Found | None:
        begin, end = self.slice(text, beginning, length)
        return self.machine.find(text, begin=begin, end=end, **how)

    def is_match(self, text: str, beginning: int = 0, length: int = -1) -> bool:
        sieve = self.machine.sieve
        if sieve is not None and sieve.decides and beginning == 0 and length < 0 and sieve.fits(text):
            return sieve.near(text)
        if self.quick is not None and beginning == 0 and length < 0 and fits(text):
            return self.quick.search(text) is not None
        return self._find(text, beginning, length) is not None

    def is_match_at_start(self, text: str, beginning: int = 0, length: int = -1) -> bool:
        return self._find(text, beginning, length, once=True) is not None

    def is_full_match(self, text: str, beginning: int = 0, length: int = -1) -> bool:
        return self._find(text, beginning, length, once=True, whole=True) is not None

    def search(self, text: str, beginning: int = 0, length: int = -1, partial: bool = False) -> Match | None:
        return next(self.iterate(text, beginning, length, partial=partial), None)

    def match_at_start(self, text: str, beginning: int = 0, length: int = -1, partial: bool = False) -> Match | None:
        found = self._find(text, beginning, length, once=True, partial=partial)
        return found and Match(self, text, found)

    def full_match(self, text: str, beginning: int = 0, length: int = -1, partial: bool = False) -> Match | None:
        found = self._find(text, beginning, length, once=True, whole=True, partial=partial)
        return found and Match(self, text, found)

    def iterate(self, text: str, beginning: int = 0, length: int = -1, *, overlapped: bool = False, partial: bool = False) -> Iterator[Match]:
        """All matches, one after the other. After an empty match the next one may begin at the
        same place but not be empty there."""
        begin, end = self.slice(text, beginning, length)
        if self.quick_records is not None and not overlapped and not partial and begin == 0 and end == len(text) and fits(text):
            for m in self.quick_records.finditer(text):
                a, b = m.span()
                found = Found(a, b, [[s] if s[0] >= 0 else [] for s in m.regs], [], m.lastindex or -1)
                yield Match(self, text, found, lambda a=a, b=b: next(self._from(text, begin, end, b, b if a == b else None, False, False), None))
            return
        yield from self._from(text, begin, end, end if self.reverse else begin, None, overlapped, partial)

    def _from(self, text: str, begin: int, end: int, pos: int, empty_at: int | None, overlapped: bool, partial: bool) -> Iterator[Match]:
        while True:
            found = self.machine.find(text, pos, begin=begin, end=end, partial=partial, empty_at=empty_at)
            if found is None:
                return
            if overlapped:
                after = found.end - 1 if self.reverse else found.start + 1
                bar = None
            else:
                after = found.start if self.reverse else found.end
                bar = after if found.start == found.end else None
            resume = (lambda a=after, e=bar: next(self._from(text, begin, end, a, e, overlapped, partial), None)) if begin <= after <= end else None
            yield Match(self, text, found, resume)
            if found.partial or not begin <= after <= end:
                return
            pos, empty_at = after, bar

    def matches(self, text: str, beginning: int = 0, length: int = -1, *, overlapped: bool = False, partial: bool = False, most: int | None = None) -> list[Match]:
        out = []
        for m in self.iterate(text, beginning, length, overlapped=overlapped, partial=partial):
            if most is not None and len(out) >= most:
                break
            out.append(m)
        return out

    def count(self, text: str, beginning: int = 0, length: int = -1, *, overlapped: bool = False) -> int:
        if self.quick is not None and not overlapped and beginning == 0 and length < 0 and fits(text):
            return sum(1 for _ in self.quick.finditer(text))
        return sum(1 for _ in self.iterate(text, beginning, length, overlapped=overlapped))

    # --- rewriting --------------------------------------------------------------------------------------------------

    def replace_n(self, text: str, by: str | Callable[[Match], str], count: int = -1, beginning: int = 0, length: int = -1, *, form: bool = False) -> tuple[str, int]:
        """Text with matches replaced, and how many were. `by`: template, format template (form) or a callable of the match."""
        begin, end = self.slice(text, beginning, length)
        if count == 0:
            return text, 0
        least = N.width(self.parsed.root)[0]
        if not self.machine.fuzzy and least > end - begin:
            return text, 0
        if isinstance(by, str):
            if form:
                self.format_template(by)
            else:
                self.template(by)
        pieces, at, n = [], (len(text) if self.reverse else 0), 0
        for m in self.iterate(text, beginning, length):
            own = by(m) if callable(by) else m.expand_format(by) if form else m.expand(by)
            if self.reverse:
                pieces += [text[m.end : at], own]
                at = m.index
            else:
                pieces += [text[at : m.index], own]
                at = m.end
            n += 1
            if n == count:
                break
        pieces.append(text[:at] if self.reverse else text[at:])
        return "".join(pieces[::-1] if self.reverse else pieces), n

    def replace(self, text: str, by: str | Callable[[Match], str], count: int = -1, beginning: int = 0, length: int = -1) -> str:
        return self.replace_n(text, by, count, beginning, length)[0]

    def replace_format(self, text: str, by: str, count: int = -1, beginning: int = 0, length: int = -1) -> str:
        return self.replace_n(text, by, count, beginning, length, form=True)[0]

    def splits(self, text: str, most: int = -1) -> Iterator[str | None]:
        """Pieces around the matches, each match's groups in between; groups that took no part are None."""
        at, n = (len(text) if self.reverse else 0), 0
        if most != 0:
            for m in self.iterate(text):
                if self.reverse:
                    yield text[m.end : at]
                    at = m.index
                else:
                    yield text[at : m.index]
                    at = m.end
                yield from m.groups()
                n += 1
                if n == most:
                    break
        yield text[:at] if self.reverse else text[at:]

    def split(self, text: str, most: int = -1) -> list[str | None]:
        return list(self.splits(text, most))

    # --- templates --------------------------------------------------------------------------------------------------

    def _group(self, name: str, template: str, at: int) -> int:
        if name.isdigit():
            g = int(name)
        elif name in self.parsed.names:
            g = self.parsed.names[name]
        elif name.isidentifier():
            raise PatternError("unknown group", template, at)
        else:
            raise PatternError("bad character in group name", template, at)
        if g > self.parsed.groups:
            raise PatternError("invalid group reference", template, at)
        return g

    @lru_cache(64)  # noqa: B019 patterns are few and cached themselves
    def template(self, template: str) -> list[str | int]:
        """Literal texts and group numbers of a replacement template."""
        out: list[str | int] = []
        i = 0
        simple = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
        while i < len(template):
            c = template[i]
            if c != "\\":
                j = template.find("\\", i)
                j = len(template) if j < 0 else j
                out.append(template[i:j])
                i = j
                continue
            at = i
            i += 1
            if i >= len(template):
                raise PatternError("bad escape (end of pattern)", template, at)
            c = template[i]
            i += 1
            if c == "g":
                end = template.find(">", i)
                if template[i : i + 1] != "<" or end < 0:
                    raise PatternError("missing <" if template[i : i + 1] != "<" else "missing >", template, i)
                out.append(self._group(template[i + 1 : end], template, i + 1))
                i = end + 1
            elif c in simple:
                out.append(simple[c])
            elif c in "xuU":
                n = {"x": 2, "u": 4, "U": 8}[c]
                digits = template[i : i + n]
                if len(digits) < n or not re.fullmatch("[0-9a-fA-F]+", digits):
                    raise PatternError("incomplete escape", template, at)
                out.append(chr(int(digits, 16)))
                i += n
            elif c == "N" and template[i : i + 1] == "{":
                end = template.find("}", i)
                try:
                    out.append(unicodedata.lookup(template[i + 1 : end]))
                except KeyError:
                    raise PatternError("undefined character name", template, at) from None
                i = end + 1
            elif c == "0" or (c in "123" and re.match("[0-7][0-7]", template[i : i + 2])):
                digits = re.match("[0-7]{1,3}", template[i - 1 :])[0]
                out.append(chr(int(digits, 8)))
                i += len(digits) - 1
            elif c.isdigit():
                if template[i : i + 1].isdigit() and int(c + template[i]) <= self.parsed.groups:
                    c += template[i]
                    i += 1
                out.append(self._group(c, template, at))
            elif c.isascii() and c.isalpha():
                raise PatternError(f"bad escape \\{c}", template, at)
            elif c == "\\":
                out.append(c)
            else:
                out.append("\\" + c)
        return out

    @lru_cache(64)  # noqa: B019
    def format_template(self, template: str) -> list[str | tuple[int, int | None]]:
        """Literal texts and (group, number of capture) of a format template."""
        out: list[str | tuple[int, int | None]] = []
        i, auto = 0, 0
        while i < len(template):
            c = template[i]
            if c in "{}" and template[i + 1 : i + 2] == c:
                out.append(c)
                i += 2
            elif c == "{":
                end = template.find("}", i)
                if end < 0:
                    raise PatternError("expected '}' before end of string", template, i)
                m = re.fullmatch(r"(\w*)(?:\[(-?\d+)\])?", template[i + 1 : end])
                if not m:
                    raise PatternError("unsupported format field", template, i)
                if m[1]:
                    g = self._group(m[1], template, i)
                else:
                    g, auto = auto, auto + 1
                    if g > self.parsed.groups:
                        raise PatternError("invalid group reference", template, i)
                out.append((g, int(m[2]) if m[2] else None))
                i = end + 1
            elif c == "}":
                raise PatternError("single '}' encountered in format string", template, i)
            else:
                j = min((k for k in (template.find("{", i), template.find("}", i)) if k >= 0), default=len(template))
                out.append(template[i:j])
                i = j
        return out


@lru_cache(256)
def _compiled(pattern: str, flags: Flag, lists: tuple, steps: int | None, seconds: float | None, on_timeout: str, max_nodes: int) -> Pattern:
    return Pattern(pattern, flags, dict(lists), steps=steps, seconds=seconds, on_timeout=on_timeout, max_nodes=max_nodes)


def compile(pattern: str | Pattern, flags: Flag | int = Flag.NONE, lists: Mapping[str, Iterable[str]] | tuple | None = None, steps: int | None = None, seconds: float | None = None, on_timeout: str = "error", max_nodes: int = MAX_NODES) -> Pattern:  # noqa: A001
    """A pattern from the cache of this process, compiled if it is not there. A text on which it uses up its steps or seconds raises
    MatchTimeout or, in columns with on_timeout null, gives null. A pattern of more than `max_nodes` nodes is refused."""
    if isinstance(pattern, Pattern):
        return pattern
    items = lists if isinstance(lists, tuple) else tuple(sorted((k, tuple(v)) for k, v in (lists or {}).items()))
    return _compiled(pattern, Flag(flags), items, steps, seconds, on_timeout, max_nodes)


def escape(text: str, special_only: bool = True, literal_spaces: bool = False) -> str:
    """Text as a pattern that matches itself. Without special_only, all but ASCII letters, digits and _ is escaped."""
    out = []
    for c in text:
        if c == " " and literal_spaces:
            out.append(c)
        elif c == "\0":
            out.append("\\000")
        elif (c in SPECIAL or c.isspace()) if special_only else not (c.isalnum() or c == "_"):
            out.append("\\" + c)
        else:
            out.append(c)
    return "".join(out)

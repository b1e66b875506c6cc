"""The parsed pattern."""

from __future__ import annotations

from dataclasses import dataclass, field

from .charset import Set


class Node:
    pass


@dataclass
class Text(Node):
    """Characters in a row; folded: compared by case folding, full: one character may fold to several."""

    chars: str
    folded: bool = False
    full: bool = False


@dataclass
class Cls(Node):
    chars: Set
    #: Spelled `.`: what line ends it leaves out ("" for none).
    dot: str | None = None


@dataclass
class Seq(Node):
    items: list[Node]


@dataclass
class Alt(Node):
    items: list[Node]


@dataclass
class Repeat(Node):
    body: Node
    low: int
    high: int | None
    #: greedy, lazy or possessive
    how: str = "greedy"


@dataclass
class Group(Node):
    body: Node
    number: int


@dataclass
class Atomic(Node):
    body: Node


@dataclass
class Look(Node):
    body: Node
    behind: bool
    negated: bool


@dataclass
class Back(Node):
    group: int | str
    folded: bool = False
    full: bool = False
    offset: int = 0


@dataclass
class Cond(Node):
    #: A group's number or name, or a Look.
    test: int | str | Look
    yes: Node
    no: Node
    offset: int = 0


@dataclass
class Define(Node):
    body: Node


@dataclass
class Call(Node):
    group: int | str
    offset: int = 0


@dataclass
class At(Node):
    """A place: start, end, end_line (before a last line feed), line_start, line_end, word, not_word, word_start, word_end, search, keep."""

    kind: str
    ascii: bool = False
    wide: bool = False


@dataclass
class Verb(Node):
    kind: str


@dataclass
class Grapheme(Node):
    pass


@dataclass
class Names(Node):
    name: str
    words: tuple[str, ...]
    folded: bool = False
    full: bool = False


@dataclass(eq=False)
class Budget:
    """Limits of the errors in a fuzzy section: least and most of s, i, d and e, and of a weighted sum."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int | None] = field(default_factory=dict)
    weights: dict[str, int] | None = None
    most: int | None = None
    test: Set | None = None

    @property
    def exact(self) -> bool:
        return self.high.get("e") == 0 or all(self.high.get(k) == 0 for k in "sid")


@dataclass
class Fuzzy(Node):
    body: Node
    budget: Budget


def children(n: Node) -> list[Node]:
    if isinstance(n, (Seq, Alt)):
        return n.items
    if isinstance(n, Cond):
        return [n.yes, n.no, *([n.test] if isinstance(n.test, Look) else [])]
    if isinstance(n, (Repeat, Group, Atomic, Look, Define, Fuzzy)):
        return [n.body]
    return []


def walk(n: Node):
    yield n
    for c in children(n):
        yield from walk(c)


def width(n: Node, groups: dict[int, Node] | None = None) -> tuple[int, int | None]:
    """Least and most characters that a node consumes; most is None for no bound."""
    if isinstance(n, Text):
        return (-(-len(n.chars) // 3) if n.full else len(n.chars)), len(n.chars)
    if isinstance(n, Cls):
        return 1, 1
    if isinstance(n, Grapheme):
        return 1, None
    if isinstance(n, Names):
        sizes = [len(w) for w in n.words] or [0]
        return (-(-min(sizes) // 3) if n.full else min(sizes)), max(sizes)
    if isinstance(n, Seq):
        parts = [width(c) for c in n.items]
        return sum(p[0] for p in parts), None if any(p[1] is None for p in parts) else sum(p[1] for p in parts)
    if isinstance(n, (Alt, Cond)):
        parts = [width(c) for c in (n.items if isinstance(n, Alt) else (n.yes, n.no))] or [(0, 0)]
        return min(p[0] for p in parts), None if any(p[1] is None for p in parts) else max(p[1] for p in parts)
    if isinstance(n, Repeat):
        a, b = width(n.body)
        return a * n.low, 0 if b == 0 else None if b is None or n.high is None else b * n.high
    if isinstance(n, (Group, Atomic)):
        return width(n.body)
    if isinstance(n, Fuzzy):
        a, b = width(n.body)
        d = n.budget.high.get("d")
        i = n.budget.high.get("i")
        e = n.budget.high.get("e")
        d = e if d is None else d if e is None else min(d, e)
        i = e if i is None else i if e is None else min(i, e)
        return 0 if d is None else max(0, a - d), None if b is None or i is None else b + i
    if isinstance(n, (Back, Call)):
        return 0, None
    return 0, 0


def reach(n: Node) -> int | None:
    """Most characters before a place that the lookbehinds of a node look at; None for no bound."""
    if isinstance(n, Look) and n.behind:
        parts = [width(n.body)[1], *(reach(c) for c in children(n))]
        return None if None in parts else sum(parts)
    parts = [reach(c) for c in children(n)]
    return None if None in parts else max(parts, default=0)


def weight(n: Node) -> int:
    """Nodes of a pattern whose counted repeats are written out, one copy of the body and a link for each repetition."""
    if isinstance(n, Repeat):
        return 3 + (n.high if n.high is not None else n.low + 1) * (weight(n.body) + 1)
    return 1 + sum(weight(c) for c in children(n))

"""The column API over compiled patterns.

Each function takes a text column and a pattern (text, or a compiled Pattern) and gives a Column. Plain literals become Catalyst string
functions, patterns that Java spells the same become rlike, regexp_extract_all and the like, and the rest runs in the backtracking matcher
in Arrow batches, once for texts of a batch that are equal. A fuzzy pattern is preceded by a test for its pieces in the JVM; rows that fail it reach Python as nulls. Null texts
give null. Positions are code points from 0."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DataType

from ..pattern import java as J
from ..pattern import nodes as N
from ..pattern.charset import cases, java_char
from ..pattern.engine import SPECIAL, Match, Pattern, compile
from ..pattern.errors import MatchTimeout
from ..pattern.flags import Flag

CAPTURE = "struct<index:int,length:int,value:string>"
GROUP = f"struct<number:int,name:string,success:boolean,index:int,length:int,value:string,captures:array<{CAPTURE}>>"
MATCH = (
    "struct<index:int,length:int,value:string,partial:boolean,subs:int,ins:int,dels:int,changes:struct<subs:array<int>,ins:array<int>,dels:array<int>>,"
    f"last_group:int,last_group_name:string,groups:array<{GROUP}>>"
)
SPAN = "struct<index:int,length:int>"

Text = Column | str
Lists = Mapping[str, Iterable[str]] | None


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(p: Pattern) -> str | None:
    """The text that a pattern stands for, if it is plain text."""
    return p.parsed.root.chars if isinstance(p.parsed.root, N.Text) and not p.parsed.root.folded and not p.reverse and not p.flags & Flag.POSIX else None


def java_form(p: Pattern, wrap: str = "{}") -> str | None:
    if p.steps is not None or p.seconds is not None:
        return None  # the JVM keeps no budgets
    try:
        return wrap.format(J.java(p)) if wrap == "{}" else wrap.replace("{}", J.java(p))
    except J.NotJava:
        return None


def near_form(p: Pattern, text: Column) -> Column | None:
    """A JVM test whether a fuzzy text is near, if the distance alone decides."""
    try:
        pieces, wide, whole = J.near(p)
    except J.NotJava:
        return None
    ascii_ = F.octet_length(text) == F.length(text)
    return F.when(ascii_ | ~text.rlike(wide), text.rlike(pieces)).otherwise(text.rlike(whole))


def echo_form(p: Pattern) -> str | None:
    """A JVM test for a pattern with fuzzy backreferences of substitutions only."""
    try:
        return J.echo(p)
    except J.NotJava:
        return None


def tier(pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, what: str = "is_match") -> str:
    """Where a call of `what` runs: literal, java, near (a fuzzy text's distance, or that of a backreference, in the JVM), filtered (pieces in the JVM, matcher in Python) or
    matcher."""
    p = compile(pattern, flags, lists)
    if literal(p) and what in ("is_match", "count"):
        return "literal"
    scan = what in ("count", "matches", "replace", "split", "findall")
    fits = not scan or J.scans_alike(p)
    if what == "split":
        fits = fits and p.group_count == 0
    if what in ("search", "matches", "replace_n_spans", "full_match", "match_at_start"):
        fits = False
    if fits and java_form(p) is not None:
        return "java"
    if what == "is_match":
        try:
            return "near" if J.near(p) else ""
        except J.NotJava:
            if echo_form(p) is not None:
                return "near"
    return "filtered" if p.machine.sieve else "matcher"


def _filter(p: Pattern, text: Column) -> Column | None:
    """A JVM test that every text with a match passes, or None."""
    if p.machine.sieve:
        spell = lambda c, f: "[" + "".join(java_char(x) for x in sorted(cases(c))) + "]" if f else J.quote(c)
        if all(not f for _, _, f in p.machine.sieve.pieces):
            out = None
            for piece, _, _ in p.machine.sieve.pieces:
                own = text.contains(piece)
                out = own if out is None else out | own
            return out
        own = ["".join(spell(c, f) for c in piece) for piece, _, f in p.machine.sieve.pieces]
        if p.machine.sieve.wide:
            own.append("[" + "".join(map(java_char, p.machine.sieve.wide)) + "]")
        return text.rlike("|".join(own))
    if p.machine.required and len(p.machine.required) > 1:
        return text.contains(p.machine.required)
    return None


def _run(p: Pattern, kind: str | DataType, work: Callable[[Pattern, str], object], *texts: Column, missing: object = None, screened: bool = True, build: Callable[[list], pa.Array] | None = None) -> Column:
    """`work` over each different text of an Arrow batch; texts without a chance of a match are not sent and give `missing`."""
    screen = _filter(p, texts[0]) if screened else None
    sent = texts[0] if screen is None else F.when(screen, texts[0])
    arrow = _arrow_type(kind)

    def within(text: str) -> object:
        try:
            return work(p, text)
        except MatchTimeout:
            if p.on_timeout == "error":
                raise
            return None

    @arrow_udf(returnType=kind)
    def run(batch: pa.Array) -> pa.Array:
        different = batch.dictionary_encode()
        own = [within(t) for t in different.dictionary.to_pylist()]
        return (build(own).cast(arrow) if build else pa.array(own, arrow)).take(different.indices)

    out = run(sent)
    if screen is None:
        return out
    return F.when(texts[0].isNull(), F.lit(None)).when(screen, out).otherwise(F.lit(missing) if not isinstance(missing, Column) else missing)


def _arrow_type(kind: str | DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind) if isinstance(kind, str) else kind)


_POINT = pa.struct([("index", pa.int32()), ("length", pa.int32()), ("value", pa.string())])


def _nested(lists: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    ends = [0, *accumulate(map(len, lists))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for own in lists for x in own], kind))


def records(ms: list[Match]) -> pa.StructArray:
    """Matches of one pattern as a MATCH array, built by columns."""
    text = [m.text for m in ms]
    found = [m.found for m in ms]
    ints = lambda xs: pa.array(xs, pa.int32())
    strings = lambda xs: pa.array(xs, pa.string())
    counts = [f.counts if f.edits else (0, 0, 0) for f in found]
    changes = [f.changes() if f.edits else ((), (), ()) for f in found]
    names = [ms[0].pattern.name_of(g) for g in range(ms[0].pattern.group_count + 1)] if ms else []
    size = len(names)
    captures = [own for f in found for own in f.captures]
    texts = [t for t in text for _ in range(size)]
    flat = [(a, b, t[a:b]) for t, own in zip(texts, captures, strict=True) for a, b in own]
    points = pa.StructArray.from_arrays([ints([a for a, _, _ in flat]), ints([b - a for a, b, _ in flat]), strings([v for _, _, v in flat])], fields=list(_POINT))
    ends = [0, *accumulate(map(len, captures))]
    last = [e - 1 if e > s else None for s, e in pairwise(ends)]
    own = points.take(pa.array(last, pa.int64()))
    group = pa.StructArray.from_arrays(
        [ints(list(range(size)) * len(ms)), strings(names * len(ms)), pa.array([x is not None for x in last]), *own.flatten(), pa.ListArray.from_arrays(ints(ends), points)],
        names=["number", "name", "success", "index", "length", "value", "captures"],
    )
    lists = [_nested([list(c[k]) for c in changes], pa.int32()) for k in range(3)]
    return pa.StructArray.from_arrays(
        [
            ints([f.start for f in found]), ints([f.end - f.start for f in found]), strings([t[f.start : f.end] for t, f in zip(text, found, strict=True)]), pa.array([f.partial for f in found], pa.bool_()),
            *(ints([c[k] for c in counts]) for k in range(3)), pa.StructArray.from_arrays(lists, names=["subs", "ins", "dels"]),
            ints([f.last for f in found]), strings([names[f.last] if 0 <= f.last < size else None for f in found]), pa.ListArray.from_arrays(ints(range(0, size * len(ms) + 1, size or 1)) if size else ints([0] * (len(ms) + 1)), group),
        ],
        names=["index", "length", "value", "partial", "subs", "ins", "dels", "changes", "last_group", "last_group_name", "groups"],
    )


def optional(ms: list[Match | None]) -> pa.StructArray:
    """Matches, or null where there is none."""
    real = [m for m in ms if m is not None]
    number = iter(range(len(real)))
    return records(real).take(pa.array([None if m is None else next(number) for m in ms], pa.int64()))


def match_lists(rows: list[list[Match] | None]) -> pa.ListArray:
    """Lists of matches; null for null."""
    ends = [0, *accumulate(0 if r is None else len(r) for r in rows)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), records([m for r in rows if r for m in r]), mask=pa.array([r is None for r in rows]))


# --- booleans -------------------------------------------------------------------------------------------------------


def is_match(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1, steps: int | None = None) -> Column:
    """Whether the pattern occurs anywhere in the slice."""
    p, t = compile(pattern, flags, lists, steps), _col(text)
    if (beginning, length) == (0, -1):
        own = literal(p)
        if own is not None:
            return t.contains(own) if own else t.isNotNull()
        form = java_form(p)
        if form is not None:
            return t.rlike(form)
        form = near_form(p, t)
        if form is not None:
            return form
        form = echo_form(p)
        if form is not None:
            return t.rlike(form)
    return _run(p, "boolean", lambda p, s: p.is_match(s, beginning, length), t, missing=False)


def is_match_at_start(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1) -> Column:
    """Whether a match begins where the slice does."""
    p, t = compile(pattern, flags, lists), _col(text)
    if (beginning, length) == (0, -1) and not p.reverse:
        own = literal(p)
        if own is not None:
            return t.startswith(own)
        form = java_form(p, "\\A(?:{})")
        if form is not None:
            return t.rlike(form)
    return _run(p, "boolean", lambda p, s: p.is_match_at_start(s, beginning, length), t, missing=False)


def is_full_match(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1) -> Column:
    """Whether a match spans the whole slice."""
    p, t = compile(pattern, flags, lists), _col(text)
    if (beginning, length) == (0, -1):
        own = literal(p)
        if own is not None:
            return t == own
        form = java_form(p, "\\A(?:{})\\z")
        if form is not None:
            return t.rlike(form)
    return _run(p, "boolean", lambda p, s: p.is_full_match(s, beginning, length), t, missing=False)


# --- match records --------------------------------------------------------------------------------------------------


def search(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1, partial: bool = False, steps: int | None = None) -> Column:
    """The first match as a MATCH struct; null if there is none."""
    p = compile(pattern, flags, lists, steps)
    return _run(p, MATCH, lambda p, s: p.search(s, beginning, length, partial), _col(text), screened=not partial, build=optional)


def match_at_start(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1, partial: bool = False) -> Column:
    p = compile(pattern, flags, lists)
    return _run(p, MATCH, lambda p, s: p.match_at_start(s, beginning, length, partial), _col(text), screened=not partial, build=optional)


def full_match(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1, partial: bool = False) -> Column:
    p = compile(pattern, flags, lists)
    return _run(p, MATCH, lambda p, s: p.full_match(s, beginning, length, partial), _col(text), screened=not partial, build=optional)


def matches(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1, overlapped: bool = False, partial: bool = False, most: int | None = None) -> Column:
    """All matches as an array of MATCH; `most` stops the scan early. posexplode() gives a row for each."""
    p = compile(pattern, flags, lists)
    work = lambda p, s: p.matches(s, beginning, length, overlapped=overlapped, partial=partial, most=most)
    return _run(p, f"array<{MATCH}>", work, _col(text), missing=F.array().cast(f"array<{MATCH}>"), screened=not partial, build=match_lists)


def spans(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, overlapped: bool = False, most: int | None = None) -> Column:
    """Index and length of all matches: the narrow form of matches()."""
    p = compile(pattern, flags, lists)
    return _run(p, f"array<{SPAN}>", lambda p, s: [{"index": m.index, "length": m.length} for m in p.matches(s, overlapped=overlapped, most=most)], _col(text), missing=F.array().cast(f"array<{SPAN}>"))


def findall(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, group: int | str = 0, overlapped: bool = False) -> Column:
    """Values of a group in all matches; null where it took no part."""
    p, t = compile(pattern, flags, lists), _col(text)
    g = p.group_numbers.get(group, group)
    if not overlapped and J.scans_alike(p) and (g == 0 or J.all_take_part(p)):
        form = java_form(p)
        if form is not None:
            return F.regexp_extract_all(t, F.lit(form), F.lit(int(g)))
    return _run(p, "array<string>", lambda p, s: [m.group(int(g)) for m in p.iterate(s, overlapped=overlapped)], t, missing=F.array().cast("array<string>"))


def group_value(text: Text, pattern: str | Pattern, group: int | str = 0, flags: Flag | int = 0, lists: Lists = None) -> Column:
    """A group's value in the first match; null without a match or if the group took no part."""
    p, t = compile(pattern, flags, lists), _col(text)
    g = int(p.group_numbers.get(group, group))
    form = java_form(p) if g == 0 or J.all_take_part(p) else None
    if form is not None:
        return F.regexp_substr(t, F.lit(form)) if g == 0 else F.when(t.rlike(form), F.regexp_extract(t, form, g))

    def own(p: Pattern, s: str) -> str | None:
        m = p.search(s)
        return m and m.group(g)

    return _run(p, "string", own, t)


def count(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, beginning: int = 0, length: int = -1, overlapped: bool = False) -> Column:
    """Number of matches."""
    p, t = compile(pattern, flags, lists), _col(text)
    if (beginning, length, overlapped) == (0, -1, False):
        own = literal(p)
        if own and len(own) == 1:
            return (F.length(t) - F.length(F.replace(t, F.lit(own), F.lit("")))).cast("int")
        form = java_form(p) if J.scans_alike(p) else None
        if form is not None:
            return F.regexp_count(t, F.lit(form)).cast("int")
    return _run(p, "int", lambda p, s: p.count(s, beginning, length, overlapped=overlapped), t, missing=0)


# --- rewriting ------------------------------------------------------------------------------------------------------


def replace(text: Text, pattern: str | Pattern, template: str, flags: Flag | int = 0, lists: Lists = None, *, count: int = -1, beginning: int = 0, length: int = -1) -> Column:
    """Text with matches replaced by a template (\\1, \\g<name>, ...)."""
    p, t = compile(pattern, flags, lists), _col(text)
    form = java_form(p)
    if (count, beginning, length) == (-1, 0, -1) and form is not None and J.scans_alike(p):
        try:
            return F.regexp_replace(t, F.lit(form), F.lit(J.template(p, template)))
        except J.NotJava:
            pass
    p.template(template)
    return _run(p, "string", lambda p, s: p.replace(s, template, count, beginning, length), t, missing=t)


def replace_with(text: Text, pattern: str | Pattern, by: Callable[[Match], str], flags: Flag | int = 0, lists: Lists = None, *, count: int = -1) -> Column:
    """Text with matches replaced by what a callable makes of each; it is called once for texts of a batch that are equal."""
    p, t = compile(pattern, flags, lists), _col(text)
    return _run(p, "string", lambda p, s: p.replace(s, by, count), t, missing=t)


def replace_n(text: Text, pattern: str | Pattern, template: str, flags: Flag | int = 0, lists: Lists = None, *, count: int = -1) -> Column:
    """struct(text, n): replaced text and number of replacements."""
    p, t = compile(pattern, flags, lists), _col(text)
    form = java_form(p)
    if count == -1 and form is not None and J.scans_alike(p):
        try:
            return F.struct(F.regexp_replace(t, F.lit(form), F.lit(J.template(p, template))).alias("text"), F.regexp_count(t, F.lit(form)).cast("int").alias("n"))
        except J.NotJava:
            pass
    p.template(template)

    def own(p: Pattern, s: str) -> dict:
        out, n = p.replace_n(s, template, count)
        return {"text": out, "n": n}

    return _run(p, "struct<text:string,n:int>", own, t, missing=F.struct(t.alias("text"), F.lit(0).alias("n")))


def replace_format(text: Text, pattern: str | Pattern, template: str, flags: Flag | int = 0, lists: Lists = None, *, count: int = -1) -> Column:
    """Text with matches replaced by a format template ({0}, {name}, {1[-1]})."""
    p, t = compile(pattern, flags, lists), _col(text)
    p.format_template(template)
    return _run(p, "string", lambda p, s: p.replace_format(s, template, count), t, missing=t)


def split(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, most: int = -1) -> Column:
    """Pieces around the matches, with each match's groups in between (null if absent)."""
    p, t = compile(pattern, flags, lists), _col(text)
    if p.group_count == 0 and J.scans_alike(p) and most != 0:
        form = java_form(p)
        if form is not None:
            return F.split(t, form, most + 1 if most > 0 else -1)
    return _run(p, "array<string>", lambda p, s: p.split(s, most), t, missing=F.array(t))


def enumerate_splits(text: Text, pattern: str | Pattern, flags: Flag | int = 0, lists: Lists = None, *, most: int = -1) -> Column:
    """A generator of (pos, col) rows of split(), for select()."""
    return F.posexplode_outer(split(text, pattern, flags, lists, most=most))


def escape(text: Text, special_only: bool = True, literal_spaces: bool = False) -> Column:
    """Text as a pattern that matches itself."""
    if special_only:
        kinds = "".join("\\" + c for c in sorted(SPECIAL)) + ("\\t\\n\\x0B\\f\\r" if literal_spaces else "\\s\\x0B")
        return F.replace(F.regexp_replace(_col(text), f"([{kinds}])", "\\\\$1"), F.lit("\0"), F.lit("\\000"))
    keep = "\\p{IsAlphabetic}\\p{N}_\\x00" + (" " if literal_spaces else "")
    return F.replace(F.regexp_replace(_col(text), f"([^{keep}])", "\\\\$1"), F.lit("\0"), F.lit("\\000"))


def expand(match: Column, pattern: str | Pattern, template: str, flags: Flag | int = 0, lists: Lists = None) -> Column:
    """A template filled in from a MATCH struct, in Catalyst."""
    p = compile(pattern, flags, lists)
    parts = [F.lit(x) if isinstance(x, str) else F.coalesce(match["groups"][x]["value"], F.lit("")) for x in p.template(template)]
    return F.when(match.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def expand_format(match: Column, pattern: str | Pattern, template: str, flags: Flag | int = 0, lists: Lists = None) -> Column:
    """A format template filled in from a MATCH struct, in Catalyst."""
    p = compile(pattern, flags, lists)
    parts = []
    for x in p.format_template(template):
        if isinstance(x, str):
            parts.append(F.lit(x))
            continue
        g, k = x
        own = match["groups"][g]["captures"]
        at = -1 if k is None else k if k < 0 else k + 1
        parts.append(F.coalesce(F.try_element_at(own, F.lit(at))["value"], F.lit("")))
    return F.when(match.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def register(spark: SparkSession) -> None:
    """SQL names: fz_is_match(text, pattern), fz_count, fz_replace(text, pattern, template), fz_split, fz_search, and the table function
    fz_matches(text, pattern) for LATERAL."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import _parse_datatype_string

    def add(name: str, kind: str, work: Callable) -> None:
        arrow = _arrow_type(kind)

        def run(*cols: pa.Array) -> pa.Array:
            own = [None if None in row else work(compile(row[1]), row[0], *row[2:]) for row in zip(*(c.to_pylist() for c in cols), strict=True)]
            # Patterns differ by row, so their records are built one by one.
            return pa.concat_arrays([optional([m]).cast(arrow) for m in own]) if kind == MATCH and own else pa.array(own, arrow)

        by_size = {2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[3 if name == "fz_replace" else 2]
        by_size.__annotations__ = {**{n: pa.Array for n in by_size.__code__.co_varnames}, "return": pa.Array}
        spark.udf.register(name, arrow_udf(by_size, _parse_datatype_string(kind)))

    add("fz_is_match", "boolean", lambda p, s: p.is_match(s))
    add("fz_count", "int", lambda p, s: p.count(s))
    add("fz_search", MATCH, lambda p, s: p.search(s))
    add("fz_split", "array<string>", lambda p, s: p.split(s))
    add("fz_replace", "string", lambda p, s, t: p.replace(s, t))

    @udtf(returnType="ordinal: int, index: int, length: int, value: string, subs: int, ins: int, dels: int")
    class Matches:
        def eval(self, text: str, pattern: str):
            if text is not None and pattern is not None:
                for n, m in enumerate(compile(pattern).iterate(text)):
                    yield (n, m.index, m.length, m.value, *m.fuzzy_counts)

    spark.udtf.register("fz_matches", Matches)


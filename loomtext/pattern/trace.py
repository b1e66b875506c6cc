"""Paths through one fuzzy text by a table of distances, in the matcher's order.

The matcher tries exact, substitution, insertion, deletion and turns back where the limit is used up, which takes a time that grows with a
power of the limit. With the fewest errors from each place to the end of the text known, it need not turn back: the first way that still
fits is the one that it would end on."""

from __future__ import annotations

from collections.abc import Sequence

from . import nodes as N
from .charset import cases

FAR = 1 << 60
#: Starts that share a table.
AT_ONCE = 64
#: Cells of a table that is made at once.
SHORT = 4096


def fuzzy_text(root: N.Node) -> tuple[str, bool, bool, int | None] | None:
    """The characters, whether case is folded, whether fully, and the most errors (None for no limit) of a pattern that is one text whose
    number of errors is its only limit; None for other patterns."""
    parts = [root]
    while isinstance(parts[0], N.Seq) and len(parts[0].items) == 1:
        parts = parts[0].items
    if not isinstance(parts[0], N.Fuzzy):
        return None
    b, body = parts[0].budget, parts[0].body
    while isinstance(body, N.Seq) and len(body.items) == 1:
        body = body.items[0]
    most = b.high["e"]
    if not isinstance(body, N.Text) or not body.chars or b.weights is not None or b.test is not None or b.low:
        return None
    if any(b.high[k] is not None and (most is None or b.high[k] < most) for k in "sid"):
        return None
    return body.chars, body.folded, body.full, most


class Trace:
    """First paths of a fuzzy text of the characters `chars`, compared by case folding if `folded`."""

    def __init__(self, chars: str, folded: bool):
        self.wanted = [cases(c) if folded else frozenset(c) for c in chars]

    def _table(self, text: str, first: int, last: int, end: int, limit: int, whole: bool, closed: int) -> list[tuple[int, list[int]]]:
        """For each character of the pattern, and behind the last, its first place and the fewest errors from the places on, as far as a
        path of `limit` errors that starts in [first, last] gets; no path inserts at the place `closed`."""
        size = len(self.wanted)
        lo, hi = max(first, first + size - limit), min(end, last + size + limit)
        row = [end - i for i in range(lo, hi + 1)] if whole else [0] * (hi - lo + 1)
        rows = [(lo, row)]
        for k in range(size - 1, -1, -1):
            want, below, under = self.wanted[k], row, lo
            lo, hi = max(first, first + k - limit), min(end, last + k + limit)
            row = [0] * (hi - lo + 1)
            # What is behind the text's end, or out of a path's reach, is far.
            i = hi
            over, right = (FAR, FAR) if hi == end else (below[hi + 1 - under], FAR)
            while i >= lo:
                down = below[i - under] if i >= under else FAR
                if i < end and text[i] in want:
                    least = over if over <= down else down + 1
                else:
                    least = over if over < down else down
                    if right < least and i != closed:
                        least = right
                    least += 1
                row[i - lo] = right = least
                over = down
                i -= 1
            rows.append((lo, row))
        return rows[::-1]

    def _path(self, text: str, start: int, end: int, limit: int, rows: list[tuple[int, list[int]]], whole: bool, closed: int) -> tuple[int, list[tuple[str, int]]]:
        """Where the first path of at most `limit` errors from `start` ends, and its edits; there is one."""
        def fits(k: int, i: int, room: int) -> bool:
            lo, row = rows[k]
            return lo <= i < lo + len(row) and row[i - lo] <= room

        k, i, edits = 0, start, []
        while k < len(self.wanted):
            room = limit - len(edits) - 1
            if i < end and text[i] in self.wanted[k]:
                if fits(k + 1, i + 1, room + 1):
                    k, i = k + 1, i + 1
                    continue
            elif i < end and fits(k + 1, i + 1, room):
                edits.append(("s", i))
                k, i = k + 1, i + 1
                continue
            elif i < end and i != closed and fits(k, i + 1, room):
                edits.append(("i", i))
                i += 1
                continue
            edits.append(("d", i))
            k += 1
        if whole:
            edits += [("i", j) for j in range(i, end)]
            i = end
        return i, edits

    def whole(self, text: str, begin: int, end: int, most: int | None, best: bool) -> tuple[int, list[tuple[str, int]]] | None:
        """The first path over the whole of text[begin:end] with at most `most` errors; `best`: with the fewest."""
        size = len(self.wanted)
        # No path has more errors than characters of both.
        limit = end - begin + size if most is None else min(most, end - begin + size)
        if abs(end - begin - size) > limit:
            return None
        # In long texts fewest errors are looked for within narrow limits first, as the table is as wide as these.
        wide = max(abs(end - begin - size), 4) if best and (end - begin) * size > SHORT else limit
        while True:
            wide = min(wide, limit)
            rows = self._table(text, begin, begin, end, wide, True, -1)
            least = rows[0][1][begin - rows[0][0]]
            if least <= wide:
                return self._path(text, begin, end, least if best else limit, rows, True, -1)
            if wide == limit:
                return None
            wide *= 2

    def first(self, text: str, starts: Sequence[int], origin: int, end: int, limit: int, opening: bool) -> tuple[int, int, list[tuple[str, int]]] | None:
        """Start, end and edits of the first path of at most `limit` errors from the first of the ascending `starts` that has one. Unless
        `opening`, none begins with an insertion at the search's `origin`."""
        closed, k = -1 if opening else origin, 0
        while k < len(starts):
            # Neighbouring starts share a table.
            z = k + 1
            while z < len(starts) and starts[z] == starts[z - 1] + 1 and z - k < AT_ONCE:
                z += 1
            rows = self._table(text, starts[k], starts[z - 1], end, limit, False, closed)
            for at, least in zip(range(starts[k], starts[z - 1] + 1), rows[0][1], strict=False):
                if least <= limit:
                    return at, *self._path(text, at, end, limit, rows, False, closed)
            k = z
        return None

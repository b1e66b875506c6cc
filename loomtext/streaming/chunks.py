"""Matches over text that arrives in chunks, whatever the chunks' borders.

A match is final once no text to come can change it: the search runs so that touching the end of what is there stops it, and then the text
from the start still open is kept (with some before it, for lookbehind and word boundaries). The rest is let go."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..pattern.engine import Pattern, compile
from ..pattern.flags import Flag
from ..pattern.matcher import Found
from ..pattern.nodes import reach

#: Characters before the open start that are kept for boundaries, on top of what the pattern's lookbehinds reach.
BEHIND = 64


@lru_cache(256)
def behind(pattern: Pattern) -> int:
    """Characters before the open start that decide about matches to come; ValueError if a lookbehind of the pattern has no bound."""
    most = reach(pattern.parsed.root)
    if most is None:
        raise ValueError("a lookbehind without a bound would need the whole stream; give its repeats an upper bound")
    return BEHIND + most


@dataclass
class Feed:
    """The state of one stream: kept text, the offset of its first character in the stream, where the next search begins in it, and where
    an empty match may not be."""

    pattern: Pattern
    text: str = ""
    offset: int = 0
    pos: int = 0
    empty_at: int = -1

    def push(self, chunk: str, last: bool = False) -> list[tuple[int, str]]:
        """Final matches (offset in the stream, value) that the next chunk settles; with `last`, all that are left."""
        self.text += chunk
        out = []
        machine = self.pattern.machine
        while self.pos <= len(self.text):
            machine.more = not last
            machine.cut_off = self.offset > 0
            try:
                bar = self.empty_at if self.empty_at >= 0 else None
                found: Found | None = machine.find(self.text, self.pos, open_end=not last, empty_at=bar)
            finally:
                machine.more = machine.cut_off = False
            if found is None:
                self.pos = len(self.text) + (1 if last else 0)
                break
            if found.partial:
                self.pos = found.start
                break
            out.append((self.offset + found.start, self.text[found.start : found.end]))
            self.pos = found.end
            self.empty_at = found.end if found.start == found.end else -1
        drop = max(0, min(self.pos, len(self.text)) - behind(self.pattern))
        if drop:
            self.text, self.offset, self.pos = self.text[drop:], self.offset + drop, self.pos - drop
            self.empty_at = self.empty_at - drop if self.empty_at >= drop else -1
        return out


def scan_chunks(chunks: DataFrame, pattern: str, flags: Flag | int = 0, *, key: str = "stream_id", order: str = "seq", text: str = "chunk", last: str = "last") -> DataFrame:
    """stream_id, index, value of every match in a streaming DataFrame of chunks (key, order, text, last).

    State is kept by stream: the open tail of its text and the number of the next chunk. Chunks of one micro-batch are put in order;
    `last` marks a stream's end, at which its state goes. Chunks must come in order over micro-batches. Null chunks are empty. A pattern
    with a lookbehind of no bound is refused."""
    flags = int(flags)
    behind(compile(pattern, flags))

    def work(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed = Feed(compile(pattern, flags), *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(order)
        found: list[tuple[int, str]] = []
        ended = False
        for chunk, end in zip(rows[text], rows[last], strict=True):
            found += feed.push(chunk if isinstance(chunk, str) else "", bool(end))
            ended = ended or bool(end)
        if ended:
            state.remove()
        else:
            state.update((feed.text, feed.offset, feed.pos, feed.empty_at))
        yield pd.DataFrame({key: [keys[0]] * len(found), "index": [f[0] for f in found], "value": [f[1] for f in found]})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, index long, value string", "text string, offset long, pos long, empty_at long", "append", GroupStateTimeout.NoTimeout)

"""Errors of the pattern layer."""

from __future__ import annotations


class PatternError(ValueError):
    """A pattern or template that cannot be compiled; `offset` is where in `pattern`, if known."""

    def __init__(self, message: str, pattern: str = "", offset: int | None = None):
        super().__init__(message if offset is None else f"{message} at offset {offset}")
        self.message, self.pattern, self.offset = message, pattern, offset


class MatchTimeout(TimeoutError):
    """A match that used up its budget of steps or seconds."""

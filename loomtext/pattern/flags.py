"""Options of a pattern."""

from __future__ import annotations

from enum import IntFlag


class Flag(IntFlag):
    NONE = 0
    IGNORECASE = 0x1
    MULTILINE = 0x2
    SINGLELINE = 0x4
    VERBOSE = 0x8
    ASCII = 0x10
    UNICODE = 0x20
    REVERSE = 0x40
    WORD = 0x80
    BESTMATCH = 0x100
    ENHANCEMATCH = 0x200
    POSIX = 0x400
    FULLCASE = 0x800
    VERSION0 = 0x1000
    VERSION1 = 0x2000
    LOCALE = 0x4000


LETTERS = {
    "i": Flag.IGNORECASE, "m": Flag.MULTILINE, "s": Flag.SINGLELINE, "x": Flag.VERBOSE, "a": Flag.ASCII, "u": Flag.UNICODE, "r": Flag.REVERSE,
    "w": Flag.WORD, "b": Flag.BESTMATCH, "e": Flag.ENHANCEMATCH, "p": Flag.POSIX, "f": Flag.FULLCASE, "L": Flag.LOCALE,
}
#: These hold for a whole pattern, wherever they stand.
GLOBAL = Flag.BESTMATCH | Flag.ENHANCEMATCH | Flag.POSIX | Flag.REVERSE | Flag.VERSION0 | Flag.VERSION1
ENCODINGS = Flag.ASCII | Flag.UNICODE | Flag.LOCALE

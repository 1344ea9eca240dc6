"""Cut texts into the matches of the byte-level tokenizers' split pattern."""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Callable
from itertools import islice

import pyarrow as pa

#: Below this code point the letter, number and space classes are the same in
#: every Unicode version, so one set of character ranges serves all engines.
_STABLE = 0x250


def give_back() -> None:
    """Return freed memory to the system, which Arrow's pool and the C library
    keep for a process's next use; a worker waits beside the JVM meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _members(test: Callable[[str], bool]) -> str:
    return "".join(re.escape(c) for c in map(chr, range(_STABLE)) if test(c))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that returns all matches of ``pattern`` in a text. Patterns
    made of the classes L, N and white space run on the standard engine over
    texts of stable code points and on the full Unicode engine over others."""
    import regex

    full = regex.compile(pattern).findall
    letter = _members(lambda c: unicodedata.category(c)[0] == "L")
    number = _members(lambda c: unicodedata.category(c)[0] == "N")
    space = re.escape("\t\n\x0b\x0c\r \x85\xa0")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    plain = plain.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    plain = plain.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    if r"\p" in plain or "(?i" in plain:
        return full
    quick = re.compile(plain).findall
    other = re.compile(f"[^\x00-{chr(_STABLE - 1)}]").search
    return lambda text: full(text) if other(text) else quick(text)


class Remembered(dict):
    """Results by pre-token, made on first use. What is kept is bounded by
    bytes: pre-tokens over LONGEST characters are worked out each time, and
    when BUDGET is reached the older half is forgotten."""

    #: Bytes of keys and results, with ROOM for the objects and their table slot.
    BUDGET, ROOM, LONGEST = 32 << 20, 208, 64

    def __init__(self, make: Callable):
        self.make, self.used = make, 0

    def __missing__(self, piece):
        out = self.make(piece)
        if len(piece) <= self.LONGEST:
            self.make_room()
            self.put(piece, out)
        return out

    def put(self, piece, out) -> None:
        self[piece] = out
        self.used += len(piece) + len(out) + self.ROOM

    def make_room(self) -> None:
        if self.used > self.BUDGET:
            for piece in list(islice(self, (len(self) + 1) // 2)):
                self.used -= len(piece) + len(self.pop(piece)) + self.ROOM

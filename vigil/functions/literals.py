"""Very many literals found in many texts, by hashes of windows.

An automaton's states take some thousand bytes a pattern; here a pattern takes
its own bytes and a hash. Hashes of all windows of one length come from one
running sum over a batch's bytes, a bitmap drops most windows, buckets tell
those that have a pattern's hash, and the bytes themselves are compared then. Patterns of several lengths share the test of their first bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from vigil.functions.automaton import buffers, slices

#: Bytes of a batch whose windows are hashed at once, at least.
PART = 1 << 19
#: Bytes compared at once.
COMPARED = 1 << 22
_BASE = 0x9E6D2C8A51F3B7D5
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _matrix(raw: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """The windows of a length as rows."""
    return np.lib.stride_tricks.sliding_window_view(raw, length)[begin] if len(begin) else np.zeros((0, length), np.uint8)


def _hashed(raw: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows at some places only."""
    weights = _powers(_BASE, length)
    rows = max(1, COMPARED // length)
    parts = [(_matrix(raw, begin[i : i + rows], length).astype(np.uint64) + np.uint64(1)) @ weights for i in range(0, len(begin), rows)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _owner(bounds: np.ndarray, start: int, end: int) -> np.ndarray:
    """The text that each byte from ``start`` to ``end`` belongs to."""
    low, high = int(np.searchsorted(bounds, start, "right")) - 1, int(np.searchsorted(bounds, end, "left"))
    return np.repeat(np.arange(low, high), np.diff(np.clip(bounds[low : high + 1], start, end)))


class Hashes:
    """A set of hashes; those in doubt are told apart by a bitmap first, the
    others are looked up in buckets of one hash or two."""

    def __init__(self, hashes: np.ndarray):
        mixed = hashes * _MIX
        self.sorted = np.sort(mixed)
        bits, self.bits = max(8, (8 * len(hashes)).bit_length()), max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[mixed >> self.shift] = True
        self.begin = np.cumsum(np.append(0, np.bincount(self._bucket(mixed), minlength=1 << self.bits)), dtype=np.int32)

    def _bucket(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.there[hashes * _MIX >> self.shift])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``hashes``, place in the sorted order) of equal ones,
        where several may be equal."""
        mixed = hashes * _MIX
        bucket = self._bucket(mixed)
        low, many = self.begin[bucket], self.begin[bucket + 1] - self.begin[bucket]
        each = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        at = np.repeat(np.arange(len(hashes)), many)
        same = self.sorted[each] == mixed[at]
        return at[same], each[same]


class Sized:
    """Distinct patterns of one length, numbered as the caller does."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, length: int, number: np.ndarray):
        hashes = _hashed(raw, begin, length)
        way = np.argsort(hashes * _MIX, kind="stable")
        self.length, self.number = length, number[way]
        self.hashes, self.bytes = Hashes(hashes), _matrix(raw, begin[way], length).copy()

    def find(self, raw: np.ndarray, begin: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``begin``, pattern's number) of windows that are patterns."""
        maybe = self.hashes.maybe(hashes)
        # All patterns with one hash are compared.
        at, each = self.hashes.find(hashes[maybe])
        at = maybe[at]
        same, rows = np.zeros(len(at), bool), max(1, COMPARED // self.length)
        for i in range(0, len(at), rows):
            part = slice(i, i + rows)
            same[part] = (_matrix(raw, begin[at[part]], self.length) == self.bytes[each[part]]).all(1)
        return at[same], self.number[each[same]]


def _groups(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[Sized]:
    return [Sized(raw, begin[size == n], n, number[size == n]) for n in np.unique(size).tolist()]


class Literals:
    """Rules (match_kind, pattern), prefix or substring. Equal rules may occur
    once only."""

    def __init__(self, match_kinds: pa.Array, patterns: pa.Array):
        raw, bounds = buffers(patterns)
        size, begin = np.diff(bounds), bounds[:-1]
        inner = np.asarray(match_kinds.cast(pa.string()).to_numpy(zero_copy_only=False) == "substring", bool)
        self.empty = np.flatnonzero(size == 0)
        numbers = np.flatnonzero((size > 0) & ~inner)
        self.prefixes = _groups(raw, begin[numbers], size[numbers], numbers)
        # Lengths from a power of two to the next share the test of that many bytes.
        self.inner = []
        step = np.frexp(size)[1] - 1
        for k in np.unique(step[inner & (size > 0)]).tolist():
            numbers = np.flatnonzero(inner & (size > 0) & (step == k))
            groups = _groups(raw, begin[numbers], size[numbers], numbers)
            lead = Hashes(np.unique(_hashed(raw, begin[numbers], 1 << k))) if len(groups) > 1 else None
            self.inner.append((1 << k, lead, groups))
        self.longest = max((g.length for *_, groups in self.inner for g in groups), default=0)

    def _spots(self, raw: np.ndarray) -> Iterator[tuple[Sized, np.ndarray, int, np.ndarray, np.ndarray]]:
        """(group, bytes, their place, windows in them, hashes of those) of the
        windows that begin like a pattern of the group."""
        part = max(PART, 4 * self.longest)
        powers, back = (_powers(b, part + self.longest) for b in (_BASE, _INVERSE))
        for start in range(0, len(raw) if self.longest else 0, part):
            own = raw[start : start + part + self.longest]
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum((own + np.uint64(1)) * powers[: len(own)], out=sums[1:])
            ends = min(part, len(own))
            for first, lead, groups in self.inner:
                if len(own) < first:
                    continue
                spots = np.arange(min(ends, len(own) - first + 1))
                if lead is not None:
                    spots = spots[lead.maybe((sums[spots + first] - sums[spots]) * back[spots])]
                for group in groups:
                    at = spots[: np.searchsorted(spots, len(own) - group.length, "right")]
                    yield group, own, start, at, (sums[at + group.length] - sums[at]) * back[at]

    def _anywhere(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for group, own, start, at, hashes in self._spots(raw):
            found, number = group.find(own, at, hashes)
            place = start + at[found]
            text = np.searchsorted(bounds, place, "right") - 1
            within = place + group.length <= bounds[text + 1]
            yield text[within], number[within]

    def _begun(self, raw: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for group in self.prefixes:
            long = texts[np.diff(bounds)[texts] >= group.length]
            at, number = group.find(raw, bounds[long], _hashed(raw, bounds[long], group.length))
            yield long[at], number

    def hit(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether any rule matches, by text. A text's windows that may be
        patterns are looked up one, two, four and so on at a time until one is,
        so the work doesn't grow with the number of rules that match."""
        out = np.full(len(bounds) - 1, len(self.empty) > 0)
        for text, _ in self._begun(raw, bounds, np.flatnonzero(~out)):
            out[text] = True
        known = -1
        for group, own, start, at, hashes in self._spots(raw):
            if start != known:
                known, owner = start, _owner(bounds, start, start + len(own))
            maybe = group.hashes.maybe(hashes)
            at, hashes = at[maybe], hashes[maybe]
            text = owner[at]
            real = ~out[text] & (text == owner[at + group.length - 1])
            at, hashes, text = at[real], hashes[real], text[real]
            few = 1
            while len(at):
                begin = np.flatnonzero(np.diff(text, prepend=-1))
                nth = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
                now = nth < few
                found, _ = group.find(own, at[now], hashes[now])
                out[text[now][found]] = True
                left = ~now & ~out[text]
                at, hashes, text = at[left], hashes[left], text[left]
                few *= 2
        return out

    def matches(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, rule) that match, texts and then rules in order."""
        size = np.diff(bounds)
        found = list(self._anywhere(raw, bounds))
        found += self._begun(raw, bounds, np.arange(len(size)))
        found += [(np.arange(len(size)), np.full(len(size), rule)) for rule in self.empty.tolist()]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, rule = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
        most = int(rule.max(initial=0)) + 1
        pair = np.unique(text * most + rule)
        return pair // most, pair % most

    def matching(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``matches`` of a column slice by slice, with rows counted from the
        column's start; null texts match nothing."""
        start = 0
        for part, raw, bounds in slices(column):
            text, rule = self.matches(raw, bounds)
            real = np.asarray(part.is_valid())[text]
            yield text[real] + start, rule[real]
            start += len(part)

    def hitting(self, column: pa.Array) -> np.ndarray:
        """``hit`` of a column slice by slice; null texts match nothing."""
        found = [self.hit(raw, bounds) & np.asarray(part.is_valid()) for part, raw, bounds in slices(column)]
        return np.concatenate(found) if found else np.zeros(0, bool)

"""A structural index of JSON records: array work on the bytes of a whole batch.

Backslashes, quotes and brackets become sorted positions; runs of backslashes
and the parity of quotes say what is inside a string, and running sums of
brackets say how deep each token lies. Tokens sorted by (record, depth, place)
stand as they follow each other within one container, so grammar, keys and parents
are comparisons of neighbours. Neither nesting nor the size of numbers is limited.

A record is malformed if it isn't one JSON value, repeats a key within an
object, or holds half of a surrogate pair; null records are malformed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vigil.functions.automaton import buffers

#: Bytes of records that are indexed together (a longer record goes alone).
SLICE_BYTES = 2 << 20

STRING, OBJECT, ARRAY, SCALAR = range(4)
_OTHER, _SPACE, _OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY, _COLON, _COMMA, _TEXT = range(9)
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\n\r")] = _SPACE
for _i, _c in enumerate(b"{}[]:,"):
    _CLASS[_c] = _OPEN_OBJECT + _i
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
#: What an escaped character stands for; 0: no escape.
_ESCAPE = np.zeros(256, np.uint8)
for _c, _v in zip(b'"\\/bfnrt', b'"\\/\b\f\n\r\t'):
    _ESCAPE[_c] = _v
_HEX = np.full(256, -1, np.int64)
for _i, _c in enumerate(b"0123456789abcdef"):
    _HEX[_c] = _HEX[ord(chr(_c).upper())] = _i
# Roles of neighbours within a container.
_OPEN, _KEY, _MARK, _VALUE, _NEXT, _CLOSE = range(6)
_ALLOWED = np.zeros((2, 6, 6), bool)  # in an object or not, role, next role
for _a, _b in ((_OPEN, _KEY), (_OPEN, _CLOSE), (_KEY, _MARK), (_MARK, _VALUE), (_VALUE, _NEXT), (_VALUE, _CLOSE), (_NEXT, _KEY)):
    _ALLOWED[1, _a, _b] = True
for _a, _b in ((_OPEN, _VALUE), (_OPEN, _CLOSE), (_VALUE, _NEXT), (_VALUE, _CLOSE), (_NEXT, _VALUE)):
    _ALLOWED[0, _a, _b] = True


def _filled(flags: np.ndarray) -> np.ndarray:
    """For each place the last flagged place up to it, or -1."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def strings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of bytes as a string column."""
    size = end - begin
    offsets = np.concatenate(([0], np.cumsum(size)))
    inside = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw[inside].tobytes())])


class JsonIndex:
    """Nodes of the well-formed records, in the order of their first bytes:
    ``record``, ``kind``, ``parent`` (a node or -1), ``key`` (a number in
    ``keys``, or -1), ``end`` (the node after the last one below). ``good`` and
    ``root`` have an element for each record."""

    def __init__(self, records: pa.Array):
        self.count = len(records)
        raw, bounds = buffers(records)
        self.good = np.asarray(records.is_valid()).copy() if self.count else np.zeros(0, bool)
        self._raw, self._bounds = raw, bounds
        inside, opens, closes = self._find_strings()
        self._check_strings(inside)
        self._tokens(inside, opens, closes)

    def _of(self, place: np.ndarray) -> np.ndarray:
        """The record of each place."""
        return np.searchsorted(self._bounds, place, "right") - 1

    def _spoil(self, place: np.ndarray) -> None:
        self.good[self._of(place)] = False

    def _find_strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, bounds = self._raw, self._bounds
        slash = np.flatnonzero(raw == 92)
        fresh = np.ones(len(slash), bool)
        fresh[1:] = (np.diff(slash) > 1) | (np.diff(self._of(slash)) > 0)
        start = slash[np.maximum(_filled(fresh), 0)] if len(slash) else slash
        self._slash = slash[(slash - start) % 2 == 0]  # those that escape what follows
        escaped = np.zeros(len(raw) + 1, bool)
        escaped[self._slash + 1] = True
        at_start = bounds[:-1][bounds[:-1] < len(raw)]
        escaped[at_start] = False  # no escape reaches over the end of a record
        quote = np.flatnonzero((raw == 34) & ~escaped[:-1])
        record = self._of(quote)
        number = np.bincount(record, minlength=self.count)
        self.good &= number % 2 == 0
        keep = self.good[record]
        quote, record = quote[keep], record[keep]
        opens, closes = quote[0::2], quote[1::2]  # numbers are even, so pairs stay within records
        delta = np.zeros(len(raw) + 1, np.int8)
        delta[opens] += 1
        delta[closes + 1] -= 1
        return np.cumsum(delta[:-1], dtype=np.int8) > 0, opens, closes

    def _check_strings(self, inside: np.ndarray) -> None:
        """Control characters and escapes; what escapes become is written over
        them, and ``_gone`` are the bytes to leave out."""
        raw = self._raw
        self._spoil(np.flatnonzero((raw < 32) & inside))
        slash = self._slash[inside[self._slash]]
        self._text, self._gone = raw, np.zeros(0, np.int64)
        if not len(slash):
            return
        padded = np.concatenate((raw, np.zeros(12, np.uint8)))
        what = padded[slash + 1]
        wide = what == ord("u")
        self._spoil(slash[(_ESCAPE[what] == 0) & ~wide])
        text = raw.copy()
        plain = slash[~wide]
        text[plain] = _ESCAPE[padded[plain + 1]]
        gone = [plain + 1]
        slash = slash[wide]
        digits = _HEX[padded[slash[:, None] + np.arange(2, 6)]]
        fair = (digits >= 0).all(1)
        self._spoil(slash[~fair])
        slash, code = slash[fair], digits[fair] @ np.array([4096, 256, 16, 1])
        # A high half must be followed at once by a low one.
        high, low = (code >= 0xD800) & (code < 0xDC00), (code >= 0xDC00) & (code < 0xE000)
        follows = np.zeros(len(slash), bool)
        follows[1:] = high[:-1] & low[1:] & (np.diff(slash) == 6)
        led = np.append(follows[1:], False)
        self._spoil(slash[(high & ~led) | (low & ~follows)])
        first = ~follows
        code = np.where(led, 0x10000 + ((code - 0xD800) << 10) + np.append(code[1:], 0xDC00) - 0xDC00, code)[first]
        place, room = slash[first], np.where(led, 12, 6)[first]
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        for k in range(4):
            own = size > k
            bits = code[own] >> (6 * (size[own] - 1 - k))
            spot = place[own] + k
            real = spot < len(text)
            text[spot[real]] = (np.where(k == 0, lead[own] | bits, 0x80 | (bits & 0x3F)) & 0xFF)[real]
        rest = room - size
        each = np.repeat(place + size - np.cumsum(rest) + rest, rest) + np.arange(rest.sum())
        self._text, self._gone = text, np.unique(np.concatenate((*gone, each)))

    def _slices(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """Texts of strings, whose quotes are at begin - 1 and end."""
        if not len(self._gone):
            return strings(self._text, begin, end)
        if not hasattr(self, "_short"):
            kept = np.ones(len(self._text), bool)
            kept[self._gone[self._gone < len(kept)]] = False
            self._short = self._text[kept]
        return strings(self._short, begin - np.searchsorted(self._gone, begin), end - np.searchsorted(self._gone, end))

    def _tokens(self, inside: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> None:
        raw, bounds = self._raw, self._bounds
        kind = _CLASS[raw]
        kind[inside] = _SPACE
        mark = np.flatnonzero(kind >= _OPEN_OBJECT)
        other = kind == _OTHER
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        begins, ends = other.copy(), other.copy()
        begins[1:] &= ~other[:-1] | edge[1:-1]
        ends[:-1] &= ~other[1:] | edge[1:-1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(begins):
            fair = np.asarray(pc.match_substring_regex(strings(raw, begins, ends), _SCALAR))
            self._spoil(begins[~fair])
        place = np.concatenate((mark, opens, begins))
        stop = np.concatenate((mark + 1, closes, ends))
        what = np.concatenate((kind[mark], np.full(len(opens), _TEXT, np.uint8), np.full(len(begins), _OTHER, np.uint8)))
        way = np.argsort(place, kind="stable")
        place, stop, what = place[way], stop[way], what[way]
        record = self._of(place)

        opening = (what == _OPEN_OBJECT) | (what == _OPEN_ARRAY)
        closing = (what == _CLOSE_OBJECT) | (what == _CLOSE_ARRAY)
        step = np.cumsum(opening.astype(np.int64) - closing)
        at = np.searchsorted(record, np.arange(self.count + 1))
        base = np.concatenate(([0], step))[at[:-1]]
        depth = step - base[record]
        level = depth + closing  # a bracket counts to what it encloses
        self._spoil(place[level < 0])
        self._spoil(place[closing & (level < 1)])
        total = np.concatenate(([0], step))[at[1:]] - base
        self.good &= total == 0
        keep = self.good[record]
        place, stop, what, record, level, opening, closing = (x[keep] for x in (place, stop, what, record, level, opening, closing))
        self._link(place, stop, what, record, level, opening, closing)

    def _link(self, place, stop, what, record, level, opening, closing) -> None:
        # Each container stands a second time, as a value of the one around it.
        own = np.flatnonzero(opening)
        n = len(place)
        token = np.concatenate((np.arange(n), own))
        depth = np.concatenate((level, level[own] - 1))
        role = np.full(n + len(own), _VALUE)
        role[:n][opening] = _OPEN
        role[:n][closing] = _CLOSE
        role[:n][what == _COLON] = _MARK
        role[:n][what == _COMMA] = _NEXT
        way = np.lexsort((place[token], depth, record[token]))
        token, depth, role = token[way], depth[way], role[way]
        owner = record[token]
        same = np.zeros(len(token), bool)
        same[1:] = (owner[1:] == owner[:-1]) & (depth[1:] == depth[:-1])
        within = _filled(role == _OPEN)  # the bracket that opens what an entry lies in
        nested = depth > 0
        safe = np.maximum(within, 0)
        in_object = nested & (what[token[safe]] == _OPEN_OBJECT) if len(token) else nested
        before = np.concatenate(([_VALUE], role[:-1]))
        text = what[token] == _TEXT
        key = text & in_object & same & ((before == _OPEN) | (before == _NEXT))
        role[key] = _KEY
        before = np.concatenate(([_VALUE], role[:-1]))
        pair = nested & same & (role != _OPEN)
        wrong = pair & ~_ALLOWED[in_object.astype(int), before, role]
        wrong |= (role == _CLOSE) & ((what[token] == _CLOSE_OBJECT) != in_object)
        wrong |= ~nested & (role != _VALUE)
        self.good[owner[wrong]] = False
        roots = np.bincount(owner[~nested], minlength=self.count)
        self.good &= roots == 1

        # Keys: exact texts, numbered.
        keys = np.flatnonzero((role == _KEY) & self.good[owner])
        texts = self._slices(place[token[keys]] + 1, stop[token[keys]]).dictionary_encode()
        number = np.full(len(token), -1, np.int64)
        number[keys] = np.asarray(texts.indices)
        self.keys = texts.dictionary
        self._known = {k: i for i, k in enumerate(self.keys.to_pylist())}
        held = within[keys] * max(1, len(self._known)) + number[keys]
        distinct, first = np.unique(held, return_index=True)
        again = np.ones(len(keys), bool)
        again[first] = False
        self.good[owner[keys[again]]] = False

        values = np.flatnonzero((role == _VALUE) & self.good[owner])
        by_place = values[np.argsort(place[token[values]], kind="stable")]
        spot = place[token[by_place]]
        self.record = owner[by_place]
        kinds = np.full(9, SCALAR)
        kinds[[_TEXT, _OPEN_OBJECT, _OPEN_ARRAY]] = STRING, OBJECT, ARRAY
        self.kind = kinds[what[token[by_place]]]
        parent_place = np.where(depth[by_place] > 0, place[token[np.maximum(within[by_place], 0)]] if len(token) else 0, -1)
        self.parent = np.where(parent_place >= 0, np.searchsorted(spot, parent_place), -1)
        self.key = np.where(in_object[by_place], number[np.maximum(by_place - 2, 0)], -1)
        # A container ends where the next closing bracket of its depth stands.
        shut = np.flatnonzero(role == _CLOSE)
        opened = np.flatnonzero(role == _OPEN)
        end_place = np.zeros(n, np.int64)
        end_place[token[opened]] = place[token[shut[np.searchsorted(shut, opened)]]] if len(opened) else 0
        tokens = token[by_place]
        close = np.where(self.kind == OBJECT, end_place[tokens], np.where(self.kind == ARRAY, end_place[tokens], spot))
        self.end = np.where((self.kind == OBJECT) | (self.kind == ARRAY), np.searchsorted(spot, close), np.arange(len(spot)) + 1)
        self._begin, self._stop = spot + 1, stop[tokens]
        self.root = np.full(self.count, -1, np.int64)
        top = self.parent < 0
        self.root[self.record[top]] = np.flatnonzero(top)
        self._children = np.argsort(self.parent, kind="stable")
        self._parents = self.parent[self._children]
        self._by_key = np.lexsort((self.key, self.parent))
        self._pairs = self.parent[self._by_key] * (len(self._known) + 1) + self.key[self._by_key]
        text = self.kind == STRING
        self._filled_text = np.flatnonzero(text & (self._stop > self._begin))

    # --- nodes; -1 stands for none and gives none ---

    def is_kind(self, nodes: np.ndarray, kind: int) -> np.ndarray:
        return (nodes >= 0) & (self.kind[np.maximum(nodes, 0)] == kind) if len(self.kind) else np.zeros(len(nodes), bool)

    def get(self, nodes: np.ndarray, key: str) -> np.ndarray:
        """The value of a key of each object."""
        number = self._known.get(key)
        if number is None or not len(self._pairs):
            return np.full(len(nodes), -1, np.int64)
        wanted = nodes * (len(self._known) + 1) + number
        at = np.minimum(np.searchsorted(self._pairs, wanted), len(self._pairs) - 1)
        return np.where((nodes >= 0) & (self._pairs[at] == wanted) & self.is_kind(nodes, OBJECT), self._by_key[at], -1)

    def string(self, nodes: np.ndarray, key: str) -> np.ndarray:
        """The value of a key where it is a string."""
        found = self.get(nodes, key)
        return np.where(self.is_kind(found, STRING), found, -1)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, node) of all values directly inside arrays and objects."""
        low, high = np.searchsorted(self._parents, nodes), np.searchsorted(self._parents, nodes, "right")
        many = np.where(nodes >= 0, high - low, 0)
        each = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(np.arange(len(nodes)), many), self._children[each]

    def leaves(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, node) of all strings at or below each node that
        aren't empty, as written."""
        real = np.maximum(nodes, 0)
        low = np.searchsorted(self._filled_text, real)
        high = np.searchsorted(self._filled_text, self.end[real]) if len(self.end) else low
        many = np.where(nodes >= 0, high - low, 0)
        each = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(np.arange(len(nodes)), many), self._filled_text[each]

    def text(self, nodes: np.ndarray) -> pa.Array:
        """Contents of string nodes, null for -1."""
        real = nodes >= 0
        out = self._slices(self._begin[nodes[real]], self._stop[nodes[real]])
        return out if real.all() else out.take(pa.array(np.cumsum(real) - 1, mask=~real))

    def equals(self, nodes: np.ndarray, text: str) -> np.ndarray:
        return self.isin(nodes, (text,))

    def isin(self, nodes: np.ndarray, texts) -> np.ndarray:
        return np.asarray(pc.is_in(self.text(nodes), pa.array(list(texts), pa.large_string()))) & (nodes >= 0)

    def bytes_of(self, nodes: np.ndarray) -> np.ndarray:
        """Size of string nodes in bytes, 0 for -1."""
        return np.asarray(pc.binary_length(self.text(nodes)).fill_null(0))


def indexed(records: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array, JsonIndex]]:
    """(first record, records, their index), slices of bounded size."""
    _, bounds = buffers(records)
    start = 0
    while start < len(records):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        part = records.slice(start, end - start)
        yield start, part, JsonIndex(part)
        start = end


def string_leaves(records: pa.Array) -> pa.Array:
    """All strings of each record that aren't empty; null for malformed ones."""
    out = []
    for _, part, index in indexed(records):
        which, nodes = index.leaves(index.root)
        ends = pa.array(np.searchsorted(which, np.arange(len(part) + 1)).astype(np.int32), mask=np.append(~index.good, False))
        out.append(pa.ListArray.from_arrays(ends, index.text(nodes).cast(pa.string())))
    return pa.chunked_array(out, pa.list_(pa.string())).combine_chunks() if out else pa.array([], pa.list_(pa.string()))


def malformed(records: pa.Array) -> pa.Array:
    """Whether each record is malformed; null for null."""
    out = [~index.good for _, _, index in indexed(records)]
    flags = np.concatenate(out) if out else np.zeros(0, bool)
    return pa.array(flags, mask=np.asarray(records.is_null()) if len(records) else None)

"""Many literals found in many texts in one pass over their bytes.

A block of patterns becomes an Aho-Corasick automaton: its goto table, with the
failure links folded in, is one array over byte classes, and outputs are chained
through arrays. A batch of texts is walked side by side, one byte of each at a
step; long texts are cut into lanes that begin early enough to know every pattern
that ends in them. All of it is array work on Arrow's own buffers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of the goto table of one automaton (of four bytes each).
CELLS = 8 << 20
#: Bytes of a lane, at least.
LANE = 4096
#: Rows of a batch walked at once.
ROWS = 8192

KINDS = ("exact", "prefix", "substring", "token")
#: Bytes of names, in which no token begins.
NAME = np.zeros(256, bool)
NAME[list(b"-_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
LOWERED = np.arange(256)
LOWERED[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column if column.type == pa.large_string() else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


class Automaton:
    """Finds all occurrences of distinct patterns, which are bytes and not
    empty. With ``lowered`` texts count as if A-Z were a-z."""

    def __init__(self, patterns: list[bytes], lowered: bool = False):
        self.size = np.array([len(p) for p in patterns], np.int64)
        self.longest = int(self.size.max(initial=0))
        used = sorted({b for p in patterns for b in p})
        of_byte = np.zeros(256, np.int32)  # class 0 holds whatever no pattern has
        of_byte[used] = np.arange(1, len(used) + 1)
        self.classes = of_byte[LOWERED] if lowered else of_byte
        self.width = len(used) + 1
        letters = of_byte[np.frombuffer(b"".join(patterns), np.uint8)]
        begin = np.cumsum(self.size) - self.size
        most = len(letters) + 1
        goto, fail = np.zeros((most, self.width), np.int32), np.zeros(most, np.int64)
        node, count = np.zeros(len(patterns), np.int64), 1
        for depth in range(self.longest):  # the trie, level by level
            live = np.flatnonzero(self.size > depth)
            pair, place = np.unique(node[live] * self.width + letters[begin[live] + depth], return_inverse=True)
            parent, letter = pair // self.width, pair % self.width
            fresh = np.arange(count, count + len(pair))
            count += len(pair)
            if depth:  # a child fails to where its parent's failure goes with the same letter
                fail[fresh] = goto[fail[parent], letter]
            goto[parent, letter] = fresh
            goto[fresh] = goto[fail[fresh]]
            node[live] = fresh[place]
        self.goto, fail = goto[:count].copy(), fail[:count]
        self.pattern = np.full(count, -1, np.int64)
        self.pattern[node] = np.arange(len(patterns))
        self.next = self._chain(fail)
        self.ends = (self.pattern >= 0) | (self.next > 0)

    def _chain(self, fail: np.ndarray) -> np.ndarray:
        """For each state the nearest failure that is a pattern's end, or 0."""
        at = fail.copy()
        while True:
            on = (at > 0) & (self.pattern[at] < 0)
            if not on.any():
                return at
            at[on] = fail[at[on]]

    def hits(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, pattern) of every occurrence, places in bytes from the
        text's start, in no particular order."""
        letters = self.classes[raw]
        size, lead = np.diff(bounds), self.longest - 1
        step = max(LANE, 4 * self.longest)
        # A lane owns ``step`` bytes and is walked from ``lead`` bytes before them.
        lanes = np.maximum(1, -(-size // step))
        text = np.repeat(np.arange(len(size)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = bounds[text] + number * step
        end = np.minimum(begin + step, bounds[text + 1])
        early = np.maximum(begin - lead, bounds[text])
        length = end - early
        way = np.argsort(-length, kind="stable")
        text, begin, early, length = text[way], begin[way], early[way], length[way]
        state = np.zeros(len(text), np.int32)
        falling = -length
        found_lane, found_at, found_state = [], [], []
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(falling, -t))  # lanes longer than t
            at = early[:n] + t
            now = self.goto[state[:n], letters[at]]
            state[:n] = now
            end_here = np.flatnonzero(self.ends[now])
            if len(end_here):
                end_here = end_here[at[end_here] >= begin[end_here]]
                found_lane.append(end_here)
                found_at.append(at[end_here])
                found_state.append(now[end_here])
        none = np.zeros(0, np.int64)
        lane = np.concatenate(found_lane) if found_lane else none
        at = np.concatenate(found_at) if found_at else none
        state = np.concatenate(found_state).astype(np.int64) if found_state else none
        out_text, out_place, out_pattern = [], [], []
        while len(lane):
            own = self.pattern[state]
            real = own >= 0
            out_text.append(text[lane[real]])
            out_pattern.append(own[real])
            out_place.append(at[real] + 1 - self.size[own[real]] - bounds[text[lane[real]]])
            state = self.next[state]
            on = state > 0
            lane, at, state = lane[on], at[on], state[on]
        return tuple(np.concatenate(x) if x else none for x in (out_text, out_place, out_pattern))


class RuleBlock:
    """Rules (match_kind, pattern) of one automaton, numbered from ``first``.
    A pattern of the kind token begins where no character of a name comes
    before it. An empty pattern matches as its kind says it does."""

    def __init__(self, rules: list[tuple[str, str]], first: int = 0):
        self.first, self.count = first, len(rules)
        texts = [p.encode("utf-8", "surrogatepass") for _, p in rules]
        distinct = {t: i for i, t in enumerate(dict.fromkeys(t for t in texts if t))}
        self.automaton = Automaton(list(distinct)) if distinct else None
        kinds = np.array([KINDS.index(m) for m, _ in rules], np.int64)
        pattern = np.array([distinct.get(t, -1) for t in texts], np.int64)
        real = np.flatnonzero(pattern >= 0)
        by = real[np.argsort(pattern[real], kind="stable")]
        self.rule, self.kind = by, kinds[by]
        self.rule_at = np.searchsorted(pattern[by], np.arange(len(distinct) + 1))
        self.empty = np.flatnonzero(pattern < 0)
        self.empty_kind = kinds[self.empty]

    def matches(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, rule) that match, texts and then rules in order."""
        size = np.diff(bounds)
        texts, rules = [], []
        if self.automaton is not None:
            text, place, pattern = self.automaton.hits(raw, bounds)
            many = self.rule_at[pattern + 1] - self.rule_at[pattern]
            each = np.repeat(self.rule_at[pattern] - np.cumsum(many) + many, many) + np.arange(many.sum())
            text, place, length = np.repeat(text, many), np.repeat(place, many), np.repeat(self.automaton.size[pattern], many)
            kind = self.kind[each]
            fit = (kind == 2) | (place == 0) & ((kind == 1) | (kind == 3) | (length == size[text]))
            inner = np.flatnonzero((kind == 3) & (place > 0))
            fit[inner] = ~NAME[raw[bounds[text[inner]] + place[inner] - 1]]
            texts.append(text[fit])
            rules.append(self.rule[each[fit]])
        for rule, kind in zip(self.empty.tolist(), self.empty_kind.tolist()):
            own = np.flatnonzero(size == 0) if kind == 0 else np.arange(len(size))
            texts.append(own)
            rules.append(np.full(len(own), rule))
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(texts) * max(1, self.count) + np.concatenate(rules))
        return pair // max(1, self.count), pair % max(1, self.count) + self.first


def rule_blocks(rules, cells: int = CELLS) -> Iterator[RuleBlock]:
    """Blocks of rules, whose goto tables have about ``cells`` cells at most
    (a longer rule is a block of its own)."""
    held, size, first = [], 0, 0
    for match_kind, pattern in rules:
        own = (len(pattern.encode("utf-8", "surrogatepass")) + 1) * 128
        if held and size + own > cells:
            yield RuleBlock(held, first)
            first += len(held)
            held, size = [], 0
        held.append((match_kind, pattern))
        size += own
    if held:
        yield RuleBlock(held, first)


def slices(column: pa.Array, rows: int = ROWS) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for start in range(0, len(column), rows):
        part = column.slice(start, rows)
        yield part, *buffers(part)


def matching(column: pa.Array, blocks: list[RuleBlock]) -> pa.Array:
    """For each text the numbers of all rules that match it, in order; null
    for null texts."""
    out = []
    for part, raw, bounds in slices(column):
        found = [b.matches(raw, bounds) for b in blocks]
        text = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        rule = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        way = np.lexsort((rule, text))
        text, rule = text[way], rule[way]
        there = np.asarray(part.is_valid())
        real = there[text]
        text, rule = text[real], rule[real]
        ends = pa.array(np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32), mask=np.append(~there, False))
        out.append(pa.ListArray.from_arrays(ends, pa.array(rule.astype(np.int32))))
    return pa.chunked_array(out, pa.list_(pa.int32())).combine_chunks() if out else pa.array([], pa.list_(pa.int32()))


def matching_any(column: pa.Array, blocks: list[RuleBlock]) -> pa.Array:
    """Whether any rule matches each text; null for null texts."""
    out = np.zeros(len(column), bool)
    start = 0
    for part, raw, bounds in slices(column):
        for block in blocks:
            out[start + block.matches(raw, bounds)[0]] = True
        start += len(part)
    return pa.array(out, mask=np.asarray(column.is_null()))

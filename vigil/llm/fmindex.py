"""An FM-index over a sequence of small integers, for many patterns at once.

Symbol 0 separates: every 0 counts as a symbol of its own, smaller than all
others and ordered by place, so no pattern crosses one and suffixes differ at
the first 0 at the latest. All queries are array operations over many rows.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence that ends with 0. The first sort looks at
    as many symbols as fit in 63 bits; what is still tied, which is what
    repeats, is then sorted by doubling."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    width = min(max(1, 63 // bits), n)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)  # no 0 met so far
    for k in range(width):
        shifted = np.zeros(n, np.int64)
        shifted[: n - k] = symbols[k:] if k else symbols
        key <<= bits
        key |= np.where(open_, shifted, 0)
        open_ &= shifted != 0
    order = np.argsort(key, kind="stable")
    tied = np.zeros(n + 1, bool)
    sorted_key = key[order]
    tied[1:n] = (sorted_key[1:] == sorted_key[:-1]) & open_[order[1:]]
    head = np.where(tied[:n], 0, np.arange(n))
    np.maximum.accumulate(head, out=head)
    rank = np.empty(n, np.int64)
    rank[order] = head
    active = np.flatnonzero(tied[:n] | tied[1:])
    while len(active):
        place = order[active]
        group, ahead = rank[place], rank[place + width]
        way = np.lexsort((place, ahead, group))
        place, group, ahead = place[way], group[way], ahead[way]
        order[active] = place
        same = np.zeros(len(active) + 1, bool)
        same[1:-1] = (group[1:] == group[:-1]) & (ahead[1:] == ahead[:-1])
        head = np.where(same[:-1], 0, active)
        np.maximum.accumulate(head, out=head)
        rank[place] = head
        active = active[same[:-1] | same[1:]]
        width *= 2
    return order


class Bits:
    """A bit vector with constant-time rank: packed words and running counts."""

    def __init__(self, flags: np.ndarray):
        packed = np.zeros((len(flags) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(flags, bitorder="little")
        packed[: len(raw)] = raw
        self.word = packed.view(np.uint64)
        counts = np.bitwise_count(self.word).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.word[at] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Wavelet-tree ranks over the Burrows-Wheeler transform, and every
    ``step``-th suffix position (with those that follow a separator)."""

    def __init__(self, symbols: np.ndarray, step: int = 16, order: np.ndarray | None = None):
        """order: the suffix array, where the caller has it."""
        order = suffix_array(symbols) if order is None else order
        last = symbols[order - 1]
        self.length = len(symbols)
        size = int(symbols.max()) + 1
        counts = np.bincount(symbols, minlength=size)
        self.first = np.cumsum(counts) - counts
        kept = (order % step == 0) | (last == 0)
        self.sampled, self.sample = Bits(kept), order[kept]
        self.levels: list[tuple[Bits, int]] = []
        begin = np.zeros(size, np.int64)
        symbol = np.arange(size)
        self.shifts = range(max(1, (size - 1).bit_length()) - 1, -1, -1)
        row = last
        for shift in self.shifts:
            flags = (row >> shift) & 1 == 1
            bits, zeros = Bits(flags), int(len(row) - flags.sum())
            self.levels.append((bits, zeros))
            ones = bits.rank(begin)
            begin = np.where((symbol >> shift) & 1 == 1, zeros + ones, begin - ones)
            row = np.concatenate((row[~flags], row[flags]))
        self.begin = begin  # where each symbol's run starts in the last level

    def _rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bits, zeros), shift in zip(self.levels, self.shifts):
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i - self.begin[symbol]

    def _back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one place before that of row i."""
        symbol = np.zeros_like(i)
        for bits, zeros in self.levels:
            ones, bit = bits.rank(i), bits.get(i)
            i = np.where(bit == 1, zeros + ones, i - ones)
            symbol = symbol << 1 | bit
        return self.first[symbol] + i - self.begin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (rows of symbols, right-aligned). A symbol
        that the sequence lacks gives an empty range."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.length, np.int64)
        alive = np.arange(len(patterns))
        width = patterns.shape[1]
        for back in range(width):
            alive = alive[lengths[alive] > back] if back else alive
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - back].astype(np.int64)
            known = (symbol > 0) & (symbol < len(self.first))
            high[alive[~known]] = low[alive[~known]] = 0
            alive, symbol = alive[known], symbol[known]
            ends = self._rank(np.concatenate((symbol, symbol)), np.concatenate((low[alive], high[alive])))
            low[alive] = self.first[symbol] + ends[: len(alive)]
            high[alive] = self.first[symbol] + ends[len(alive) :]
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence, by walking back to sampled suffixes."""
        out = np.zeros(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.sampled.get(rows) == 1
            out[left[hit]] = self.sample[self.sampled.rank(rows[hit])] + steps
            left, rows = left[~hit], rows[~hit]
            if len(left):
                rows = self._back(rows)
            steps += 1
        return out

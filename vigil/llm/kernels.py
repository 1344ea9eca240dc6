"""Array kernels over Arrow text columns, used inside map functions.

A shard is a slice of an Arrow batch holding a bounded number of text bytes
(a single longer text makes a shard of its own). All positions in a shard are
byte or word positions in the concatenated texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHARD_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty. Offsets start at 0."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    if column.null_count:  # a null slot may still span bytes
        valid = np.asarray(column.is_valid())
        sizes = np.where(valid, np.diff(bounds), 0)
        if sizes.sum() != len(raw):
            keep = np.repeat(valid, np.diff(bounds))
            raw = raw[keep]
        return raw, np.concatenate(([0], np.cumsum(sizes)))
    return raw, bounds - bounds[0]


def shards(batch: pa.RecordBatch, text: str = "text", limit: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``limit`` text bytes (one row at least)."""
    _, bounds = text_buffers(batch.column(batch.schema.get_field_index(text)))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        end = min(rows, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def _table(codes: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in codes]] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word that white space ends (space, \t \n \v \f \r).
NOT_SPACE = ~_table(" \t\n\x0b\x0c\r")
#: Bytes of a word of digits, lower-case letters and whatever isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64. A worker keeps
    those of one shard; a longer text's are made for it and let go again."""

    kept: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > SHARD_BYTES + 1:
            return _powers(n)
        if cls.kept is None:
            cls.kept = _powers(SHARD_BYTES + 1)
        return cls.kept


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(raw: np.ndarray, bounds: np.ndarray, member: np.ndarray, lower: bool = True):
    """Words of each text as (start byte, end byte, 64-bit hash, texts' word
    bounds). ``member`` says for each (lowered) byte whether words hold it."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = LOWER[raw] if lower else raw
    inside = member[low]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    forward, backward = Powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * forward[:n], out=total[1:])
    code = mix((total[end] - total[start]) * backward[start])
    return start, end, code, np.searchsorted(start, bounds)


def owner(bounds: np.ndarray) -> np.ndarray:
    """Index of the text each item belongs to, from the items' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

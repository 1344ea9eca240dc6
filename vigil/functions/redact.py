"""Masking of tokens and commands."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SHOWN, LONGEST, DOTS = 4, 32, "..."


def redact_token(token: Column) -> Column:
    """A quarter of the token at most stays visible at either end, four
    characters at most; long tokens shrink to 32 characters."""
    n = F.length(token)
    each = F.when(n > 2 * SHOWN, F.least(F.lit(SHOWN), F.floor(n / 4))).otherwise(1).cast("int")
    stars = F.lit(LONGEST) - each * 2 - len(DOTS)
    left = F.floor(stars / 2).cast("int")
    head, tail = F.left(token, each), F.right(token, each)
    long = F.concat(head, F.repeat(F.lit("*"), left), F.lit(DOTS), F.repeat(F.lit("*"), stars - left), tail)
    short = F.concat(head, F.repeat(F.lit("*"), n - each * 2), tail)
    return F.when(n <= each * 2, F.repeat(F.lit("*"), n)).when(n <= LONGEST, short).otherwise(long)


def mask(token: str) -> str:
    """``redact_token`` on a Python string."""
    n = len(token)
    each = min(SHOWN, n // 4) if n > 2 * SHOWN else 1
    if n <= 2 * each:
        return "*" * n
    hidden = "*" * (n - 2 * each)
    if n > LONGEST:
        stars = LONGEST - 2 * each - len(DOTS)
        hidden = "*" * (stars // 2) + DOTS + "*" * (stars - stars // 2)
    return token[:each] + hidden + token[n - each :]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mask_commands(commands: list[str], tokens: list[list[str]], primary: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, starts, lengths): in each command all occurrences of its tokens
    masked, overlapping or touching ones as one; what follows the last is cut;
    start and length tell where the mask of the primary token is.

    A change array over the characters of the whole batch marks what is covered;
    its runs, and what stands between them, are segments of one output."""
    size = np.array([len(c) for c in commands], np.int64)
    begin = np.cumsum(size + 1) - size - 1  # a character apart, so that no run reaches into the next command
    change = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
    spots = [
        (at + m.start(), len(t)) for at, command, own in zip(begin.tolist(), commands, tokens) for t in dict.fromkeys(own) if t for m in re.finditer(re.escape(t), command)
    ]
    if spots:
        place, length = np.array(spots, np.int64).T
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
    covered = np.concatenate(([0], np.cumsum(change) > 0)).astype(np.int8)
    edges = np.diff(covered)
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(begin, start, "right") - 1
    first = np.searchsorted(owner, np.arange(len(commands)))
    runs = np.searchsorted(owner, np.arange(len(commands)), "right") - first

    # A mask: its ends shown, stars between, and dots amid the stars of long ones.
    n = stop - start
    each = np.where(n > 2 * SHOWN, np.minimum(SHOWN, n // 4), 1)
    short, long = n <= 2 * each, n > LONGEST
    each = np.where(short, 0, each)
    hidden = np.where(long, LONGEST - 2 * each - len(DOTS), n - 2 * each)
    left = np.where(long, hidden // 2, hidden)
    width = np.where(long, LONGEST, n)
    before = np.concatenate(([0], stop[:-1])) if len(start) else stop
    before = np.where(np.arange(len(start)) == first[owner], begin[owner], before)
    # Segments (place in the source, length, whether it advances): a command's end, if it is masked, is three dots.
    source = np.concatenate((_codes("\x00".join(commands)), _codes("*" + DOTS)))
    star = len(source) - len(DOTS) - 1
    dots = star + 1
    of_runs = np.stack([before, start, np.full(len(n), star), np.full(len(n), dots), np.full(len(n), star), stop - each], 1)
    lengths = np.stack([start - before, each, left, np.where(long, len(DOTS), 0), np.where(long, hidden - left, 0), each], 1)
    last = np.where(runs > 0, stop[np.maximum(first + runs - 1, 0)] if len(stop) else 0, begin)
    rest = begin + size - last
    tail = np.where(runs > 0, dots, begin)
    tail_length = np.where(runs > 0, np.where(rest > 0, len(DOTS), 0), size)
    at_run = np.arange(len(n)) * 6 + owner  # a tail for each command before
    at_tail = (first + runs) * 6 + np.arange(len(commands))
    total = len(n) * 6 + len(commands)
    where, many, moves = np.zeros(total, np.int64), np.zeros(total, np.int64), np.ones(total, np.int64)
    for k in range(6):
        where[at_run + k], many[at_run + k] = of_runs[:, k], lengths[:, k]
        moves[at_run + k] = k not in (2, 4)
    where[at_tail], many[at_tail] = tail, tail_length
    ends = np.cumsum(many)
    offset = ends - many
    inside = np.arange(int(many.sum())) - np.repeat(offset, many)
    out = source[np.repeat(where, many) + inside * np.repeat(moves, many)].tobytes().decode("utf-32-le", "surrogatepass")
    until = ends[at_tail]
    since = np.concatenate(([0], until[:-1])) if len(until) else until
    texts = [out[a:b] for a, b in zip(since.tolist(), until.tolist())]
    # The run that holds the primary token's first place.
    found = np.array([c.find(p) if p else -1 for c, p in zip(commands, primary)], np.int64)
    held = np.searchsorted(start, begin + found, "right") - 1
    real = (found >= 0) & (held >= 0)
    real[real] = (stop[held[real]] > begin[real] + found[real]) & (owner[held[real]] == np.flatnonzero(real))
    starts, widths = np.zeros(len(commands), np.int64), np.zeros(len(commands), np.int64)
    starts[real] = offset[at_run[held[real]] + 1] - since[real]
    widths[real] = width[held[real]]
    return texts, starts, widths


def mask_command(command: str, tokens: list[str], primary: str) -> tuple[str, int, int]:
    """``mask_commands`` of one command."""
    texts, starts, widths = mask_commands([command], [tokens], [primary])
    return texts[0], int(starts[0]), int(widths[0])


REDACTED = "text string, start int, length int"


def _masked(command: pa.Array, tokens: pa.Array, primary: pa.Array) -> pa.Array:
    own = [[t for t in row or () if t] for row in tokens.to_pylist()]
    texts, starts, widths = mask_commands([c or "" for c in command.to_pylist()], own, [p or "" for p in primary.to_pylist()])
    columns = [pa.array(texts, pa.string()), pa.array(starts.astype(np.int32)), pa.array(widths.astype(np.int32))]
    return pa.StructArray.from_arrays(columns, ["text", "start", "length"])


def redact_command(command: Column, tokens: Column, primary: Column) -> Column:
    """``mask_commands`` over columns, in Arrow batches. Only rows with findings
    reach it. The caller ships the package."""
    return F.arrow_udf(_masked, REDACTED)(command, tokens, primary)

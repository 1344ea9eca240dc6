"""Bytes of history files and transcripts to records.

The file reader runs these where a table's native expressions can't reach:
dotfiles, line numbers, and JSON strings in the order they were written, which
come from the structural index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vigil.functions.fixed import OVERSIZED_LINE
from vigil.functions.json_index import indexed
from vigil.sources.formats import SOURCES, extract

_EXTENDED = re.compile(r": ([+-]?[0-9]+):[^;]*;(.+)", re.DOTALL)
_INTEGER = re.compile(r"[+-]?[0-9]+")
_SHORT, _BLOB = 8, 256


def decode(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _stamp(text: str) -> int | None:
    """A time in 64 bits, or None."""
    value = int(text) if len(text) <= 20 and _INTEGER.fullmatch(text) else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def history_kind(path: str) -> str:
    for part, kind in (("fish_history", "fish"), ("/.codex/history.jsonl", "codex"), ("/.claude/history.jsonl", "claude")):
        if part in path:
            return kind
    return "jsonl" if path.endswith(".jsonl") else "shell"


def numbered_lines(data: bytes, limit: int | None = OVERSIZED_LINE) -> Iterator[tuple[int, str | None]]:
    """(number, line) without the line feed and one carriage return; None
    stands for a line that is too long."""
    for number, line in enumerate(data.split(b"\n"), 1):
        if limit and len(line) >= limit:
            yield number, None
        else:
            yield number, decode(line[:-1] if line.endswith(b"\r") else line)


def shell(data: bytes, limit: int | None = OVERSIZED_LINE):
    """(line, ts, raw, command); too long lines give (line, None, None, None)."""
    for number, line in numbered_lines(data, limit):
        if line is None:
            yield number, None, None, None
        elif line:
            found = _EXTENDED.fullmatch(line)
            stamp = _stamp(found[1]) if found else None
            yield (number, None, line, line) if stamp is None else (number, stamp, line, found[2])


def fish(data: bytes, limit: int | None = OVERSIZED_LINE):
    opened = None
    for number, line in numbered_lines(data, limit):
        if line is None:
            yield number, None, None, None
        elif line.startswith("- cmd: "):
            if opened:
                yield tuple(opened)
            opened = [number, None, line, line[7:]]
        elif line.startswith("  when: ") and opened:
            opened[1] = _stamp(line[8:])
    if opened:
        yield tuple(opened)


def _records(data: bytes) -> tuple[pa.Array, list[int]]:
    """The lines of JSONL that aren't empty, and their numbers."""
    held = [(n, decode(line)) for n, line in enumerate(data.split(b"\n"), 1) if line]
    return pa.array([t for _, t in held], pa.large_string()), [n for n, _ in held]


def jsonl_history(data: bytes):
    """Leaves of eight bytes or more that are no blobs; a line that is no JSON
    is an entry as it stands."""
    lines, numbers = _records(data)
    for first, part, index in indexed(lines):
        which, nodes = index.leaves(index.root)
        texts, size = index.text(nodes), index.bytes_of(nodes)
        kept = (size >= _SHORT) & ((size <= _BLOB) | np.asarray(pc.match_substring(texts, " ")))
        kept = np.flatnonzero(kept)
        at = np.searchsorted(which[kept], np.arange(len(part) + 1))
        for k, raw in enumerate(part.to_pylist()):
            raw, number = raw.removesuffix("\r"), numbers[first + k]
            if index.good[k]:
                yield from ((number, None, raw, leaf) for leaf in texts.take(pa.array(kept[at[k] : at[k + 1]])).to_pylist())
            elif raw:
                yield number, None, raw, raw


def agent_history(kind: str, data: bytes):
    for piece in pieces({"codex": "codex_history", "claude": "claude_history"}[kind], data)[0]:
        yield piece[0], None, piece[2], piece[2]


def entries(path: str, data: bytes, limit: int | None = OVERSIZED_LINE):
    """(line, ts, raw, command) of a history file by its path's kind."""
    kind = history_kind(path)
    if kind == "shell":
        return shell(data, limit)
    if kind == "fish":
        return fish(data, limit)
    return jsonl_history(data) if kind == "jsonl" else agent_history(kind, data)


# --- transcripts ---


def path_format(path: str) -> str:
    holds = lambda part: part in path or part.replace("/", "\\") in path
    if path.endswith(".jsonl"):
        known = (
            ("/.codex/history.jsonl", "codex_history"), ("/.codex/sessions/", "codex_session"), ("/.claude/history.jsonl", "claude_history"),
            ("/.claude/projects/", "claude"), ("/.gemini/tmp/", "gemini_jsonl"), ("/.copilot/session-state/", "copilot"),
        )
        return next((kind for part, kind in known if holds(part)), "jsonl")
    if path.endswith(".json"):
        return "gemini_json" if holds("/.gemini/tmp/") else "json"
    return "markdown" if path.endswith((".md", ".markdown")) else "text"


def pieces(kind: str, data: bytes) -> tuple[list[tuple[int, str, str]], int]:
    """([(line, source, text)], malformed records) of a transcript."""
    if kind in ("text", "markdown"):
        lines = enumerate(data.split(b"\n"), 1)
        return [(n, "stored_context", text) for n, line in lines if (text := decode(line.rstrip(b"\r")))], 0
    lines, numbers = (pa.array([decode(data)], pa.large_string()), [1]) if kind in ("json", "gemini_json") else _records(data)
    out: list[tuple[int, str, str]] = []
    bad = 0
    for first, _, index in indexed(lines):
        bad += int(np.count_nonzero(~index.good))
        record, code, text = extract(kind, index)
        out += [(numbers[first + r], SOURCES[c], t) for r, c, t in zip(record.tolist(), code.tolist(), text.to_pylist())]
    return out, bad

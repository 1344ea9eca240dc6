"""Compiled rules: the automata of a scan, with the rules they came from, as one
checked file. Scans load it instead of parsing rule files again."""

from __future__ import annotations

import hashlib
import io
import json
import os

import numpy as np

from vigil.functions.automaton import Automaton, RuleBlock
from vigil.functions.triggers import Triggers, literals

MAGIC, VERSION = b"VIGILRUL", 1
_AUTOMATON = ("size", "classes", "goto", "pattern", "next", "ends")
_BLOCK = ("rule", "kind", "rule_at", "empty", "empty_kind")


class RuleSet(list):
    """Rules (kind, match_kind, pattern, ord) with their automata: ``stored`` has
    those of plain and of deep scans."""

    stored: dict[bool, Triggers]


def _built_in() -> str:
    """What the program itself puts into the automata."""
    return hashlib.sha256(repr(literals()).encode()).hexdigest()


def _kinds(rules: list[tuple], deep: bool) -> tuple[list, list]:
    own = lambda kind: [(m, p) for k, m, p, _ in rules if k == kind or deep and k == f"deep_{kind}"]
    return own("ignore"), own("check")


def compiled(rules: list[tuple]) -> RuleSet:
    out = RuleSet(rules)
    out.stored = {deep: Triggers(*_kinds(rules, deep)) for deep in (False, True)}
    return out


def _put(arrays: dict, name: str, thing, fields) -> None:
    arrays.update({f"{name}.{f}": getattr(thing, f) for f in fields})


def _take(arrays, name: str, cls, fields):
    out = cls.__new__(cls)
    for f in fields:
        setattr(out, f, arrays[f"{name}.{f}"])
    return out


def _automaton(arrays, name: str) -> Automaton:
    out = _take(arrays, name, Automaton, _AUTOMATON)
    out.longest, out.width = int(out.size.max(initial=0)), out.goto.shape[1]
    return out


def dump(rules: RuleSet) -> bytes:
    arrays: dict[str, np.ndarray] = {}
    about = {"rules": [list(r) for r in rules], "built_in": _built_in(), "blocks": []}
    for deep, triggers in rules.stored.items():
        name = f"d{int(deep)}"
        arrays[f"{name}.bits"] = triggers.bits
        _put(arrays, f"{name}.words", triggers.words, _AUTOMATON)
        for i, block in enumerate(triggers.blocks):
            _put(arrays, f"{name}.b{i}", block, _BLOCK)
            if block.automaton is not None:
                _put(arrays, f"{name}.b{i}.a", block.automaton, _AUTOMATON)
            about["blocks"].append([deep, i, block.first, block.count, block.automaton is not None, triggers.first_check])
    held = io.BytesIO()
    np.savez(held, about=np.frombuffer(json.dumps(about).encode(), np.uint8), **arrays)
    payload = held.getvalue()
    return MAGIC + VERSION.to_bytes(4, "little") + hashlib.sha256(payload).digest() + payload


def load(data: bytes, name: str = "compiled rules") -> RuleSet:
    """Rules of a compiled file; ValueError if it is damaged, or if another
    version of the program made it."""
    head, payload = data[:44], data[44:]
    if len(head) < 44 or head[:8] != MAGIC or head[12:] != hashlib.sha256(payload).digest():
        raise ValueError(f"{name} is damaged; run config compile")
    arrays = np.load(io.BytesIO(payload), allow_pickle=False)
    about = json.loads(arrays["about"].tobytes())
    if int.from_bytes(head[8:12], "little") != VERSION or about["built_in"] != _built_in():
        raise ValueError(f"{name} was made by another version; run config compile")
    out = RuleSet(tuple(r) for r in about["rules"])
    out.stored = {}
    for deep, i, first, count, full, first_check in about["blocks"]:
        key = f"d{int(deep)}"
        if deep not in out.stored:
            out.stored[deep] = triggers = Triggers.__new__(Triggers)
            triggers.bits, triggers.first_check, triggers.blocks = arrays[f"{key}.bits"], first_check, []
            triggers.words = _automaton(arrays, f"{key}.words")
        block = _take(arrays, f"{key}.b{i}", RuleBlock, _BLOCK)
        block.first, block.count = first, count
        block.automaton = _automaton(arrays, f"{key}.b{i}.a") if full else None
        out.stored[deep].blocks.append(block)
    return out


def write(path: str, rules: list[tuple]) -> RuleSet:
    """Compile rules into a file, which is replaced in one step."""
    out = compiled(rules)
    fresh = f"{path}.{os.getpid()}.new"
    with open(fresh, "wb") as file:
        file.write(dump(out))
    os.replace(fresh, path)
    return out


def read(path: str) -> RuleSet:
    with open(path, "rb") as file:
        return load(file.read(), path)

"""Transcript formats over a structural index: which strings of a batch of
records are which part of a transcript. No record is looked at by itself."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from vigil.functions.json_index import ARRAY, OBJECT, STRING, JsonIndex

SOURCES = ("user_input", "tool_call", "tool_output", "stored_context", "assistant", "reasoning")
_CODE = {s: i for i, s in enumerate(SOURCES)}


class _Parts:
    """Strings found so far, with what puts them in order: the record, then
    ``rank`` keys, then their own place."""

    def __init__(self, index: JsonIndex):
        self.index, self.found = index, []

    def add(self, source, nodes: np.ndarray, where: np.ndarray | None = None, *ranks) -> None:
        """Nodes that are strings and aren't empty; ``source`` is a name or an
        array of codes."""
        index = self.index
        fit = index.is_kind(nodes, STRING)
        fit[fit] &= index._stop[nodes[fit]] > index._begin[nodes[fit]]
        if where is not None:
            fit &= where
        code = np.full(len(nodes), _CODE[source]) if isinstance(source, str) else source
        ranks = [np.full(len(nodes), r) if np.isscalar(r) else r for r in (*ranks, 0, 0, 0)[:3]]
        self.found.append(tuple(x[fit] for x in (nodes, code, *ranks)))

    def under(self, source, nodes: np.ndarray, where: np.ndarray | None = None, *ranks) -> None:
        """All strings at or below the nodes."""
        if where is not None:
            nodes = np.where(where, nodes, -1)
        at, leaf = self.index.leaves(nodes)
        pick = lambda x: x if isinstance(x, str) or np.isscalar(x) else x[at]
        self.add(pick(source), leaf, None, *map(pick, ranks))

    def ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(record, code of the source, node)."""
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        node, code, *ranks = (np.concatenate(x) for x in zip(*self.found))
        record = self.index.record[node]
        way = np.lexsort((node, *reversed(ranks), record))
        return record[way], code[way], node[way]


def _blocks(parts: _Parts, source, nodes: np.ndarray, where: np.ndarray, *ranks) -> None:
    """Text of content values: a string, or the text of the blocks of an array."""
    index = parts.index
    parts.add(source, nodes, where, *ranks)
    nodes = np.where(where & index.is_kind(nodes, ARRAY), nodes, -1)
    at, block = index.children(nodes)
    pick = lambda x: x if isinstance(x, str) or np.isscalar(x) else x[at]
    parts.add(pick(source), index.string(block, "text"), None, *map(pick, ranks))


def _claude(parts: _Parts, root: np.ndarray) -> None:
    index = parts.index
    content = index.get(index.get(root, "message"), "content")
    kind = index.string(root, "type")
    user, assistant = index.equals(kind, "user"), index.equals(kind, "assistant")
    parts.add("user_input", content, user)
    at, block = index.children(np.where(index.is_kind(content, ARRAY), content, -1))
    what = index.string(block, "type")
    _blocks(parts, "tool_output", index.get(block, "content"), user[at] & index.equals(what, "tool_result"))
    parts.under("tool_call", index.get(block, "input"), assistant[at] & index.equals(what, "tool_use"))
    parts.add("assistant", index.string(block, "text"), assistant[at] & index.equals(what, "text"))
    parts.add("reasoning", index.string(block, "thinking"), assistant[at] & index.equals(what, "thinking"))


def _claude_history(parts: _Parts, root: np.ndarray) -> None:
    index = parts.index
    parts.add("user_input", index.string(root, "display"), None, 0)
    pasted = index.string(root, "pastedContents")
    parts.add("user_input", pasted, index.bytes_of(pasted) > 2, 1)


def _codex_history(parts: _Parts, root: np.ndarray) -> None:
    parts.add("user_input", parts.index.string(root, "text"))


def _codex_session(parts: _Parts, root: np.ndarray) -> None:
    index = parts.index
    payload = np.where(index.equals(index.string(root, "type"), "response_item"), index.get(root, "payload"), -1)
    kind = index.string(payload, "type")
    user = index.equals(index.string(payload, "role"), "user")
    _blocks(parts, np.where(user, _CODE["user_input"], _CODE["assistant"]), index.get(payload, "content"), index.equals(kind, "message"))
    call = index.isin(kind, ("function_call", "custom_tool_call"))
    parts.add("tool_call", index.string(payload, "arguments"), call, 0)
    parts.under("tool_call", index.get(payload, "input"), call, 1)
    parts.add("tool_output", index.string(payload, "output"), index.isin(kind, ("function_call_output", "custom_tool_call_output")))
    parts.under("reasoning", index.get(payload, "summary"), index.equals(kind, "reasoning"))


def _gemini(parts: _Parts, root: np.ndarray, rank: int = 0) -> None:
    """Messages; several of one record stay in their order."""
    index = parts.index
    kind = index.string(root, "type")
    named = kind >= 0
    bare = (root >= 0) & ~named
    at = root  # the message's own place
    parts.under("stored_context", index.get(root, "$set"), bare, rank, at, 0)
    parts.under("assistant", index.get(root, "summary"), bare, rank, at, 1)
    parts.under("stored_context", index.get(root, "memoryScratchpad"), bare, rank, at, 2)
    user, own = index.equals(kind, "user"), index.equals(kind, "gemini")
    source = np.where(user, _CODE["user_input"], np.where(own, _CODE["assistant"], _CODE["stored_context"]))
    parts.under(source, index.get(root, "content"), named, rank, at, 0)
    parts.under("user_input", index.get(root, "displayContent"), user, rank, at, 1)
    calls = index.get(root, "toolCalls")
    which, call = index.children(np.where(own & index.is_kind(calls, ARRAY), calls, -1))
    # Calls stand one after the other, each with its parts in a fixed order.
    place = np.arange(len(call)) * 3 + 1
    for n, (key, where) in enumerate((("args", "tool_call"), ("result", "tool_output"), ("resultDisplay", "tool_output"))):
        parts.under(where, index.get(call, key), None, rank, at[which], place + n)
    parts.under("reasoning", index.get(root, "thoughts"), own, rank, at, len(call) * 3 + 1)


def _gemini_document(parts: _Parts, root: np.ndarray) -> None:
    index = parts.index
    messages = index.get(root, "messages")
    _, message = index.children(np.where(index.is_kind(messages, ARRAY), messages, -1))
    _gemini(parts, message)
    listed = index.is_kind(messages, ARRAY)
    parts.under("assistant", index.get(root, "summary"), listed, 1)
    parts.under("stored_context", index.get(root, "memoryScratchpad"), listed, 2)
    parts.under("stored_context", root, messages < 0)


def source_of_event(kind: str) -> str:
    if kind.startswith(("user.", "prompt.")):
        return "user_input"
    if "reason" in kind:
        return "reasoning"
    if kind.startswith("assistant."):
        return "assistant"
    if kind.startswith("tool."):
        return "tool_call" if "start" in kind or "request" in kind else "tool_output"
    return "stored_context"


def _copilot(parts: _Parts, root: np.ndarray) -> None:
    index = parts.index
    kind = index.string(root, "type")
    named = np.flatnonzero(kind >= 0)
    kinds = index.text(kind[named]).dictionary_encode()
    codes = np.array([_CODE[source_of_event(k)] for k in kinds.dictionary.to_pylist()] or [0])  # event names are few
    source = np.full(len(root), _CODE["stored_context"])
    source[named] = codes[np.asarray(kinds.indices)]
    data = index.get(root, "data")
    parts.under(source, np.where((kind >= 0) & (data >= 0), data, root))


def _any(parts: _Parts, root: np.ndarray) -> None:
    parts.under("stored_context", root)


EXTRACT: dict[str, Callable[[_Parts, np.ndarray], None]] = {
    "claude": _claude, "claude_history": _claude_history, "codex_history": _codex_history, "codex_session": _codex_session, "gemini_jsonl": _gemini,
    "copilot": _copilot, "jsonl": _any, "gemini_json": _gemini_document, "json": _any,
}


def extract(kind: str, index: JsonIndex) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(record, code in SOURCES, text) of all parts of the indexed records, in
    order."""
    parts = _Parts(index)
    EXTRACT[kind](parts, index.root)
    record, code, node = parts.ordered()
    return record, code, index.text(node)

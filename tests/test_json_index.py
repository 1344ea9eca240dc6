"""The structural index against the standard library's parser, and the formats
on it against a model that takes records apart one by one."""

import json
import random

import pyarrow as pa
import pytest

from vigil.functions import json_index
from vigil.functions.json_index import malformed, string_leaves
from vigil.sources.parsers import pieces


def load(text):
    """(value, whether it is JSON as this package sees it)."""

    def bad(name):
        raise ValueError(name)

    def once(pairs):
        return dict(pairs) if len(dict(pairs)) == len(pairs) else bad("repeated key")

    try:
        value = json.loads(text, parse_constant=bad, object_pairs_hook=once, parse_int=len, parse_float=len)
        json.dumps(value, ensure_ascii=False).encode()
        return value, True
    except (ValueError, UnicodeEncodeError):
        return None, False


def leaves(value):
    if isinstance(value, str):
        return [value] if value else []
    inner = value if isinstance(value, list) else value.values() if isinstance(value, dict) else ()
    return [x for v in inner for x in leaves(v)]


def word(r):
    return "".join(r.choice(list('a"\\é日😀\n\t/{[,: u0\x07kb')) for _ in range(r.randint(0, 6)))


def value(r, depth):
    k = r.randint(0, 9)
    if depth <= 0 or k < 3:
        return word(r)
    if k < 5:
        return r.choice([1, -0.5, 1e30, True, False, None, 12345678901234567890, 0])
    return [value(r, depth - 1) for _ in range(r.randint(0, 4))] if k < 7 else {word(r): value(r, depth - 1) for _ in range(r.randint(0, 4))}


ODD = ["", " ", '{"a":1,"a":2}', '{"a":1,"\\u0061":2}', '"\\ud83d\\ude00"', '"\\ud83d"', '"\\ud83d\\u0041"', "NaN", "-", "\ufeff1", '"\\', "\\", '"a"b', "[1 2]", "{}{}", "]", "[}", '{"a"}', "1.e5", "nul"]


def record(r):
    if r.random() < 0.05:
        return r.choice(ODD)
    text = json.dumps(value(r, r.randint(0, 5)), ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 1]))
    for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
        i, k = r.randrange(len(text) + 1), r.random()
        put = r.choice(list('"\\{}[]:,0 -.eu\n') + ["\\ud800", "\\udc00", "\\u0041", "tru", "null", "01", '"a":1,'])
        text = text[:i] + text[i + 1 :] if k < 0.4 else text[:i] + put + text[i:] if k < 0.8 else text[:i] + text[i + 1 : i + 3] + text[i:]
    return text


@pytest.mark.parametrize("seed", range(4))
def test_leaves_and_verdicts(seed, monkeypatch):
    r = random.Random(seed)
    good = 0
    for _ in range(150):
        records = [None if r.random() < 0.02 else record(r) for _ in range(r.randint(1, 30))]
        monkeypatch.setattr(json_index, "SLICE_BYTES", r.choice([1, 200, 1 << 20]))
        column = pa.array(["x", *records], pa.string()).slice(1)
        bad = malformed(column).to_pylist()
        for text, found, spoiled in zip(records, string_leaves(column).to_pylist(), bad):
            parsed, fine = load(text) if text is not None else (None, False)
            good += fine
            assert found == (leaves(parsed) if fine else None) and spoiled == (None if text is None else not fine), text
    assert good > 500


def test_depth_and_size_have_no_limit():
    texts = ["[" * 5000 + '"x"' + "]" * 5000, "1" * 10_000, '{"a":' * 3000 + '"y"' + "}" * 3000, "[" * 5000, "]" * 10, '"' + "z" * 3_000_000 + '"']
    assert string_leaves(pa.array(texts)).to_pylist() == [["x"], [], ["y"], None, None, ["z" * 3_000_000]]
    assert string_leaves(pa.array([], pa.string())).to_pylist() == [] and malformed(pa.array([None], pa.string())).to_pylist() == [None]


# --- formats, one record at a time ---


def own(record, key):
    found = record.get(key) if isinstance(record, dict) else None
    return found if isinstance(found, str) else None


def blocks(content):
    return [content] if isinstance(content, str) else [own(b, "text") for b in content] if isinstance(content, list) else []


def under(record, *keys):
    for k in keys:
        record = record.get(k) if isinstance(record, dict) else None
    return leaves(record)


def claude(record):
    message = record.get("message") if isinstance(record, dict) else None
    content = message.get("content") if isinstance(message, dict) else None
    kind = own(record, "type")
    out = [("user_input", content)] if kind == "user" and isinstance(content, str) else []
    for block in content if isinstance(content, list) else ():
        what = own(block, "type")
        if (kind, what) == ("user", "tool_result"):
            out += [("tool_output", t) for t in blocks(block.get("content"))]
        if kind == "assistant":
            out += [("tool_call", t) for t in under(block, "input")] if what == "tool_use" else []
            out += [("assistant", own(block, "text"))] if what == "text" else [("reasoning", own(block, "thinking"))] if what == "thinking" else []
    return out


def session(record):
    payload = record.get("payload") if own(record, "type") == "response_item" else None
    kind = own(payload, "type")
    if kind == "message":
        return [("user_input" if own(payload, "role") == "user" else "assistant", t) for t in blocks(payload.get("content"))]
    if kind in ("function_call", "custom_tool_call"):
        return [("tool_call", t) for t in (own(payload, "arguments"), *under(payload, "input"))]
    if kind in ("function_call_output", "custom_tool_call_output"):
        return [("tool_output", own(payload, "output"))]
    return [("reasoning", t) for t in under(payload, "summary")] if kind == "reasoning" else []


def gemini(record):
    kind = own(record, "type")
    parts = lambda source, *keys: [(source, t) for t in under(record, *keys)]
    if kind is None:
        return parts("stored_context", "$set") + parts("assistant", "summary") + parts("stored_context", "memoryScratchpad")
    out = parts({"user": "user_input", "gemini": "assistant"}.get(kind, "stored_context"), "content")
    if kind == "user":
        out += parts("user_input", "displayContent")
    if kind == "gemini":
        calls = record.get("toolCalls")
        for call in calls if isinstance(calls, list) else ():
            out += [(s, t) for k, s in (("args", "tool_call"), ("result", "tool_output"), ("resultDisplay", "tool_output")) for t in under(call, k)]
        out += parts("reasoning", "thoughts")
    return out


def document(record):
    if not isinstance(record, dict) or "messages" not in record:
        return [("stored_context", t) for t in leaves(record)]
    if not isinstance(record["messages"], list):
        return []
    out = [x for m in record["messages"] if isinstance(m, dict) for x in gemini(m)]
    return out + [("assistant", t) for t in under(record, "summary")] + [("stored_context", t) for t in under(record, "memoryScratchpad")]


MODELS = {"claude": claude, "codex_session": session, "gemini_jsonl": gemini, "gemini_json": document}
KEYS = "type message content role text thinking input payload arguments output summary $set memoryScratchpad displayContent toolCalls args result resultDisplay thoughts messages".split()
WORDS = "user assistant tool_use tool_result text thinking message function_call custom_tool_call function_call_output reasoning gemini info".split() + ["", 'é\n"q', "x" * 300]


def shaped(r, depth):
    k = r.random()
    if depth <= 0 or k < 0.35:
        return r.choice(WORDS)
    if k < 0.42:
        return r.choice([1, None, True, 2.5])
    return [shaped(r, depth - 1) for _ in range(r.randint(0, 3))] if k < 0.62 else {x: shaped(r, depth - 1) for x in r.sample(KEYS, r.randint(0, 6))}


def typed(r):
    return {x: shaped(r, 3) for x in r.sample(KEYS, r.randint(2, 9))} | {"type": r.choice(WORDS)}


@pytest.mark.parametrize("kind", sorted(MODELS))
def test_formats(kind):
    r = random.Random(kind)
    found = 0
    for _ in range(1200):
        records = []
        for _ in range(1 if kind == "gemini_json" else r.randint(0, 5)):
            made = shaped(r, 4) if r.random() < 0.2 else typed(r)
            if r.random() < 0.7:
                inner = [typed(r) for _ in range(3)]
                made = {
                    "claude": {"type": r.choice(("user", "assistant")), "message": {"content": r.choice(["hi", inner])}},
                    "codex_session": {"type": "response_item", "payload": inner[0]},
                    "gemini_jsonl": {"type": "gemini", "toolCalls": inner, "content": shaped(r, 2), "thoughts": shaped(r, 2)},
                    "gemini_json": {"messages": inner, "summary": shaped(r, 2), "memoryScratchpad": shaped(r, 2)},
                }[kind]
            records.append(made)
        data = "\n".join(json.dumps(x, ensure_ascii=r.random() < 0.5) for x in records) + r.choice(["", "\n{cut", "\r\n"]) * (kind != "gemini_json")
        want = [(n, s, t) for n, x in enumerate(records, 1) for s, t in MODELS[kind](x) if t]
        got, bad = pieces(kind, data.encode())
        assert got == want and bad == sum(not load(x)[1] for x in data.split("\n") if x)
        found += len(want)
    assert found > 400

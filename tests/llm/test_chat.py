import json

from vigil.llm.chat import ChatFormatter, canonical, contracted, parse, validate

SCHEMAS = {"add": {"properties": {"a": {"type": "number"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}}


def call(*calls, content=None):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls], "content": content}, indent=1)


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_validation():
    s = SCHEMAS["add"] | {"type": "object"}
    assert validate({"a": 1, "b": 2.5}, s) == []
    assert validate({"a": True, "c": 1}, s) == ["$.b: missing", "$.a: not of type number", "$.c: not allowed"]
    assert validate({"a": {"$ref": "x"}, "b": 1}, s) == []
    assert validate([1, "x"], {"type": "array", "items": {"type": "integer"}}) == ["$[1]: not of type integer"]
    assert validate("abc", {"enum": ["a"], "maxLength": 2}) == ["$: not one of the allowed values", "$: too long"]
    assert validate(5, {"minimum": 6}) and validate(5, {"maximum": 4}) and not validate(None, {"type": ["null", "string"]})


def test_odd_texts_are_plain():
    for text in (None, "", "{", '{"tool_calls": []}', '{"tool_calls": [1]}', '{"a": NaN}', "[" * 100_000, '{"a":' * 100_000, '{"a": "\\ud800"}'):
        got = parse("user", text, {})
        assert got["kind"] == "plain" and json.loads(got["json"]) == {"role": "user", "content": text}


def test_canonical():
    assert canonical({"b": 1, "a": ["é", 1.5, 10**30]}) == '{"a":["é",1.5,1000000000000000000000000000000],"b":1}'


ROWS = [
    (1, 0, "user", "add things"),
    (1, 1, "assistant", call(("c3", "add", {"a": {"$ref": "c2"}, "b": 0}), ("c1", "add", {"a": 1, "b": 2}), ("c2", "add", {"a": {"$ref": "c1"}, "b": 3}))),
    (1, 2, "tool", result("c3", 6)),
    (1, 3, "tool", result("c1", 3)),
    (1, 4, "tool", result("c2", 6)),
    (1, 5, "tool", result("c2", "again")),
    (1, 6, "assistant", call(("c1", "add", {"a": 9, "b": 9}))),
    (1, 7, "assistant", call(("x", "add", {"a": {"$ref": "y"}, "b": 1}), ("y", "add", {"a": {"$ref": "x"}, "b": 1}), ("z", "nope", {}), ("w", "add", {"a": {"$ref": "gone"}, "b": 1}))),
    (1, 8, "tool", result("orphan", None)),
    (1, 9, "tool", result("x", None)),
    (2, 0, "tool", result("c1", "of another conversation")),
    (None, 0, "tool", result("c1", "nowhere")),
    (3, None, None, None),
    (3, 1, "user", ""),
    (3, 1, "user", ""),
]


def test_linking_and_order(spark):
    messages = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, json string").repartition(4)
    chat = ChatFormatter(spark, SCHEMAS)
    calls = {(r.call_id, r.call_turn): r for r in chat.link(messages).collect()}
    assert {k: r.level for k, r in calls.items()} == {("c1", 1): 0, ("c2", 1): 1, ("c3", 1): 2, ("c1", 6): None, ("x", 7): None, ("y", 7): None, ("z", 7): 0, ("w", 7): None}
    assert {k: r.result_turn for k, r in calls.items() if r.result_turn is not None} == {("c1", 1): 3, ("c2", 1): 4, ("c3", 1): 2, ("x", 7): 9}
    assert [k for k, r in calls.items() if r.duplicate] == [("c1", 6)]
    assert [k for k, r in calls.items() if not r.valid] == [("z", 7)] and calls["z", 7].errors == ["$: unknown tool"]
    got = chat.format(messages).collect()
    assert len(got) == len(ROWS)
    first = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_level, r.order_index, r.turn))
    assert [r.turn for r in first] == [0, 1, 3, 4, 2, 5, 6, 7, 9, 8]
    assert [r.turn for r in got if r.linked and r.conv_id != 1] == []
    assert sum(r.n_calls for r in got) == 8 and sum(r.n_invalid for r in got) == 1
    for r in got:
        assert r.json == canonical(json.loads(r.json))
    assert [r.json for r in got if r.conv_id == 3 and r.turn is None] == ['{"content":null,"role":null}']


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert ChatFormatter(spark, SCHEMAS).format(none).count() == 0


def test_levels_agree_with_brute_force(spark):
    import random

    draw = random.Random(11)
    needs = {(1, f"c{i}"): [f"c{i - 1}"] if i else [] for i in range(3000)}  # one long chain, over several blocks
    for conv in range(2, 8):  # random graphs, some with cycles and unknown ids
        for i in range(40):
            pool = [f"c{j}" for j in range(i)] + (["gone", f"c{draw.randrange(40)}"] if conv > 4 and draw.random() < 0.1 else [])
            needs[conv, f"c{i}"] = draw.sample(pool, min(len(pool), draw.randint(0, 3)))
    needs |= {(10, f"c{i}"): [f"c{(i + 1) % 1500}"] for i in range(1500)}  # a ring over several blocks
    needs |= {(11, f"c{i}"): [] for i in range(1500)} | {(11, "hub"): [f"c{i}" for i in range(0, 1500, 9)], (11, "user"): ["hub"], (11, "last"): ["user", "c1"]}
    needs |= {(9, "a"): ["b"], (9, "b"): ["c"], (9, "c"): ["a"], (9, "d"): ["a", "e"], (9, "e"): []}

    def level(key, seen=()):
        if key[0] == 10 or key not in needs or key in seen:
            return None
        below = [level((key[0], n), (*seen, key)) for n in needs[key]]
        return None if None in below else 1 + max(below, default=-1)

    order = sorted(needs)
    draw.shuffle(order)
    rows = [(conv, turn, "assistant", call((i, "add", {"a": [{"$ref": n} for n in needs[conv, i]]}))) for turn, (conv, i) in enumerate(order)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r.level for r in ChatFormatter(spark, SCHEMAS).link(messages).collect()}
    known = {k: lv for k, lv in got.items() if k[0] == 1}
    assert known == {(1, f"c{i}"): i for i in range(3000)}
    assert {k: v for k, v in got.items() if k[0] > 1} == {k: level(k) for k in needs if k[0] > 1}


def test_contraction_keeps_many_ends_apart():
    wide = [f"x{i}" for i in range(100)]
    keys = [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (1, "p"), (1, "q"), (1, "r")]
    got = contracted(keys, [wide, ["a"], ["b", "x5"], ["a"], ["q"], ["p"], ["p", "b"]])
    assert got[0] == (0, True, dict.fromkeys(wide, 1))
    assert got[1:4] == [(0, True, {"a": 1}), (1, True, {"a": 2, "x5": 1}), (0, True, {"a": 1})]
    assert got[4:] == [(0, False, {})] * 2 + [(got[6][0], False, {})]


def test_derived_calls_reach_the_method(spark):
    from vigil.llm.chat import dialogue_calls

    rows = [(1, 0, "system", "x"), (1, 1, "user", "a b"), (1, 2, "assistant", "c"), (1, 3, "user", ""), (1, 5, "user", "y"), (1, 6, "assistant", None), (2, 0, "user", None), (None, None, "user", "n")]
    tools = {"search": {"properties": {"query": {"type": "string", "minLength": 1}}}, "combine": {}}
    chat = ChatFormatter(spark, tools)
    derived = dialogue_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    calls = {(r.conv_id, r.call_id): (r.level, r.valid, r.result_turn) for r in chat.link(derived).collect()}
    assert calls == {
        (1, "u1"): (0, True, 10), (1, "u3"): (0, False, None), (1, "s3"): (1, True, None), (1, "u5"): (0, True, 26), (1, "s5"): (2, True, None), (2, "u0"): (0, False, None),
    }
    assert chat.format(derived).where("linked").count() == 2

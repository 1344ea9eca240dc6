"""Chat formatting with linked tool calls.

A message is plain text, or JSON text of one of two shapes:

    {"tool_calls": [{"id": str, "name": str, "arguments": object}, ...], "content": any}
    {"tool_call_id": str, "content": any}

Calls and results of a conversation are hash-joined by (conversation, id). An
argument {"$ref": id} makes a call depend on another; calls are put in
topological order by levels (0: no dependencies; else one more than the
highest of those it depends on). Neighbouring calls are first contracted in
blocks of ``BLOCK``: each call gets the longest paths to the calls outside its
block that it hangs on. Only calls that another block hangs on, few of a chain,
then take part in pointer doubling: each holds the calls at the far ends of its
dependency paths, and every round replaces each end by that call's own ends, so
a chain over n blocks takes log2(n) rounds of joins. Arguments are validated
against the tool's schema, and every message is serialised as canonical JSON:
sorted keys, no spaces, UTF-8, integers and floats as they were read.

Messages stay rows: a conversation is never gathered, so one that holds a
third of all rows is spread like any other. ``order_turn``, ``order_level``
and ``order_index`` put the messages of a conversation in order: a linked
result stands directly behind its call's message, by level and by place.

Nulls: a null text is a plain message with null content; null roles stay null;
rows without conversation or turn are kept and link with nothing. Text that is
no JSON, or JSON of another shape, is plain. A call id that repeats in a
conversation belongs to its first call (by turn, then place); the others are
marked ``duplicate``. Of several results for one call the first is linked.
Calls in a cycle, or that depend (also through others) on an id without a
call, have level null. Repeated rows are formatted one by one. Input columns
other than conv_id, turn, role and text are ignored, whatever their names.

``dialogue_calls`` derives messages with calls and results from plain
dialogues, by a rule, for corpora that hold none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import materialize, ship_package

#: The schemas of all tools are broadcast; their JSON may not be larger.
MAX_SCHEMA_BYTES = 16 << 20

#: Neighbouring calls that are contracted together.
BLOCK = 1024
#: A call with more open ends than this isn't contracted into those that need it.
MANY_ENDS = 64

KIND = (
    "struct<kind:string,json:string,result_id:string,n_invalid:bigint,"
    "calls:array<struct<id:string,name:string,valid:boolean,errors:array<string>,needs:array<string>>>>"
)
_ARROW = pa.struct(
    [
        ("kind", pa.string()), ("json", pa.string()), ("result_id", pa.string()), ("n_invalid", pa.int64()),
        ("calls", pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("valid", pa.bool_()), ("errors", pa.list_(pa.string())), ("needs", pa.list_(pa.string()))]))),
    ]
)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(name)


def _read(text: str | None):
    """The JSON object in a text, or None."""
    if not text or text.lstrip(" \t\n\r")[:1] != "{":
        return None
    try:
        found = json.loads(text, parse_constant=_no_constant)
        canonical(found).encode()
        return found
    except (ValueError, RecursionError, UnicodeError):
        return None


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


def is_reference(value) -> bool:
    return isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str)


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, by path. Understood are type, enum, const,
    properties, required, additionalProperties, items, minimum, maximum,
    minLength and maxLength. A reference stands for a value not known yet."""
    if is_reference(value):
        return []
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the allowed values")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{at}.{k}")
            elif isinstance(more := schema.get("additionalProperties", True), dict):
                out += validate(value[k], more, f"{at}.{k}")
            elif not more:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += validate(v, schema["items"], f"{at}[{i}]")
    if _TYPES["number"](value):
        out += [f"{at}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    return out


def references(value) -> list[str]:
    if is_reference(value):
        return [value["$ref"]]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return sorted({r for v in inner for r in references(v)})


def parse(role: str | None, text: str | None, schemas: dict) -> dict:
    """KIND of one message."""
    found = _read(text)
    calls = found.get("tool_calls") if found else None
    shaped = isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls)
    if shaped:
        out, plain = [], []
        for c in calls:
            arguments = c.get("arguments", {})
            if isinstance(arguments, str):  # arguments may be given as JSON text
                inner = _read(arguments)
                arguments = arguments if inner is None else inner
            schema = schemas.get(c["name"])
            errors = ["$: unknown tool"] if schema is None else validate(arguments, {"type": "object"} | schema)
            out.append({"id": c["id"], "name": c["name"], "valid": not errors, "errors": errors, "needs": references(arguments)})
            plain.append({"id": c["id"], "name": c["name"], "arguments": arguments})
        message = {"role": role, "content": found.get("content"), "tool_calls": plain}
        return {"kind": "call", "json": canonical(message), "result_id": None, "n_invalid": sum(not c["valid"] for c in out), "calls": out}
    if found and isinstance(found.get("tool_call_id"), str):
        message = {"role": role, "content": found.get("content"), "tool_call_id": found["tool_call_id"]}
        return {"kind": "result", "json": canonical(message), "result_id": found["tool_call_id"], "n_invalid": 0, "calls": []}
    return {"kind": "plain", "json": canonical({"role": role, "content": text}), "result_id": None, "n_invalid": 0, "calls": []}


def contracted(keys: list[tuple], needs: list[list[str]]) -> list[tuple[int, bool, dict[str, int]]]:
    """For calls (conversation, id) and the ids they need: the longest path to
    a call that needs nothing, whether the call is free of cycles within the
    block, and the longest path to each id outside it (or to a call with very
    many of those, which stands for them)."""
    own = {k: i for i, k in enumerate(keys)}
    inner = [[own[c, x] for x in need if (c, x) in own] for (c, _), need in zip(keys, needs)]
    ends = [{x: 1 for x in need if (c, x) not in own} for (c, _), need in zip(keys, needs)]
    base, waits, users = [0] * len(keys), [len(found) for found in inner], [[] for _ in keys]
    for i, found in enumerate(inner):
        for j in found:
            users[j].append(i)
    ready = [i for i, n in enumerate(waits) if not n]
    for j in ready:  # grows on the way
        for i in users[j]:
            if len(ends[j]) > MANY_ENDS:
                ends[i].setdefault(keys[j][1], 1)
            else:
                base[i] = max(base[i], base[j] + 1)
                for x, far in ends[j].items():
                    ends[i][x] = max(ends[i].get(x, 0), far + 1)
            waits[i] -= 1
            if not waits[i]:
                ready.append(i)
    return [(b, not n, {} if n else e) for b, n, e in zip(base, waits, ends)]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, call_id, needs) in order -> the same calls, contracted by blocks."""
    kind = pa.list_(pa.struct([("end", pa.string()), ("far", pa.int32())]))
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            conv, call = part.column("conv_id"), part.column("call_id")
            base, sound, ends = zip(*contracted(list(zip(conv.to_pylist(), call.to_pylist())), part.column("needs").to_pylist()))
            far = pa.array([[{"end": x, "far": n} for x, n in e.items()] for e in ends], kind)
            yield pa.RecordBatch.from_arrays([conv, call, pa.array(base, pa.int32()), pa.array(sound), far], ["conv_id", "call_id", "base", "sound", "ends"])


class ChatFormatter:
    """schemas: JSON schema of the arguments by tool name."""

    def __init__(self, spark: SparkSession, schemas: dict[str, dict]):
        ship_package(spark)
        if len(canonical(schemas)) > MAX_SCHEMA_BYTES:
            raise ValueError("the schemas are too large to broadcast")
        self.spark, self.schemas = spark, spark.sparkContext.broadcast(schemas)

    def _parsed(self, messages: DataFrame) -> DataFrame:
        schemas = self.schemas

        def read(role: pa.Array, text: pa.Array) -> pa.Array:
            return pa.array([parse(r.as_py(), t.as_py(), schemas.value) for r, t in zip(role, text)], _ARROW)

        slim = messages.select(
            F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
            F.arrow_udf(read, KIND)(F.col("role").cast("string"), F.col("text").cast("string")).alias("m"),
        )
        return materialize(self.spark, slim.select("conv_id", "turn", "role", "m.*"), "messages")

    def _calls(self, parsed: DataFrame) -> DataFrame:
        """(conv_id, call_id, name, call_turn, index, valid, errors, needs, duplicate)."""
        calls = parsed.where("kind = 'call'").select("conv_id", F.col("turn").alias("call_turn"), F.posexplode("calls").alias("index", "c"))
        calls = calls.select("conv_id", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), "call_turn", "index", "c.valid", "c.errors", "c.needs")
        # Ranked within one id of one conversation.
        order = Window.partitionBy("conv_id", "call_id").orderBy(F.col("call_turn").asc_nulls_last(), "index", F.to_json(F.struct("name", "needs", "errors")))
        return calls.withColumn("duplicate", F.row_number().over(order) > 1)

    def _leveled(self, calls: DataFrame) -> DataFrame:
        """(conv_id, call_id, level) of the first calls of each id, where it exists."""
        spark, key = self.spark, ["conv_id", "call_id"]
        first = calls.where(~F.col("duplicate") & F.col("conv_id").isNotNull())
        # Neighbours share a partition; a long conversation spreads over many.
        near = first.repartitionByRange("conv_id", "call_turn", "index").sortWithinPartitions("conv_id", "call_turn", "index")
        kind = f"conv_id {dict(first.dtypes)['conv_id']}, call_id string, base int, sound boolean, ends array<struct<end:string,far:int>>"
        every = materialize(spark, near.select(*key, F.array_distinct("needs").alias("needs")).mapInArrow(_contract, kind), "blocks")
        open_ends = every.where("sound").select(*key, F.explode("ends").alias("e")).select(*key, "e.end", "e.far")
        borders = self._borders(every, open_ends).withColumnRenamed("call_id", "end")
        found = open_ends.join(borders, ["conv_id", "end"], "left").groupBy(*key)
        # An end without level is no call, or runs into a cycle.
        found = found.agg(F.max(F.col("level") + F.col("far")).alias("reached"), F.bool_and(F.col("level").isNotNull()).alias("all_sound"))
        joined = every.where("sound").join(found, key, "left").where(F.coalesce("all_sound", F.lit(True)))
        return joined.select(*key, F.greatest("base", F.coalesce("reached", F.lit(0))).alias("level"))

    def _borders(self, every: DataFrame, open_ends: DataFrame) -> DataFrame:
        """(conv_id, call_id, level), where it exists, of calls that are an end of others."""
        spark, key = self.spark, ["conv_id", "call_id"]
        wanted = open_ends.select("conv_id", F.col("end").alias("call_id")).distinct()
        border = materialize(spark, every.join(wanted, key, "left_semi"), "borders")
        # (call, end, far): the longest path found from a call to an open end; base: the longest to a resolved call.
        ends, known = border.select(*key, F.explode("ends").alias("e")).select(*key, "e.end", "e.far"), border.select(*key, "base", "sound")
        # A path without cycle is shorter than the border calls of its conversation.
        longest = known.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        for _ in range(longest.bit_length() + 1):
            if ends.isEmpty():
                break
            at = known.select("conv_id", F.col("call_id").alias("end"), F.col("base").alias("end_base"), F.col("sound").alias("end_sound"))
            found = ends.join(at, ["conv_id", "end"], "left")
            reached = found.groupBy(*key).agg(F.max(F.coalesce("end_base", F.lit(0)) + F.col("far")).alias("reached"), F.min(F.coalesce("end_sound", F.lit(False))).alias("all_sound"))
            further = ends.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("far").alias("more"))
            nearer = ends.join(further, ["conv_id", "end"]).groupBy("conv_id", "call_id", F.col("next").alias("end")).agg(F.max(F.col("far") + F.col("more")).alias("far"))
            joined = known.join(reached, key, "left")
            base, sound = F.greatest("base", F.coalesce("reached", F.lit(0))), F.col("sound") & F.coalesce("all_sound", F.lit(True))
            known = materialize(spark, joined.select(*key, base.alias("base"), sound.alias("sound")), "calls")
            ends = materialize(spark, nearer, "ends")
        # Whoever still has an open end runs into a cycle.
        return known.where("sound").join(ends.select(*key).distinct(), key, "left_anti").select(*key, F.col("base").alias("level"))

    def link(self, messages: DataFrame) -> DataFrame:
        """One row for each call: conv_id, call_id, name, call_turn, index,
        valid, errors, duplicate, level, result_turn (null: no result)."""
        return self._linked(self._parsed(messages))

    def _linked(self, parsed: DataFrame) -> DataFrame:
        calls = materialize(self.spark, self._calls(parsed), "calls")
        levels = self._leveled(calls)
        results = parsed.where("kind = 'result'").groupBy("conv_id", F.col("result_id").alias("call_id")).agg(F.min("turn").alias("result_turn"), F.lit(True).alias("answered"))
        out = calls.drop("needs").join(levels, ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left")
        own = lambda c: F.when(~F.col("duplicate"), F.col(c))
        return out.withColumns({"level": own("level"), "result_turn": own("result_turn")}).drop("answered")

    def format(self, messages: DataFrame) -> DataFrame:
        """One row for each message: conv_id, turn, role, kind (plain, call or
        result), linked (a result that is its call's first), order_turn,
        order_level, order_index, n_calls, n_invalid, json."""
        parsed = self._parsed(messages)
        links = self._linked(parsed).where(~F.col("duplicate")).select("conv_id", F.col("call_id").alias("result_id"), "call_turn", "index", "level", "result_turn")
        plain = parsed.where("kind <> 'result'").withColumns({k: F.lit(None).cast(t) for k, t in (("call_turn", "long"), ("index", "int"), ("level", "int"), ("result_turn", "long"))})
        joined = parsed.where("kind = 'result'").join(links, ["conv_id", "result_id"], "left")
        every = plain.unionByName(joined)
        linked = F.coalesce(F.col("result_turn") == F.col("turn"), F.lit(False))
        return every.select(
            "conv_id", "turn", "role", "kind", linked.alias("linked"),
            F.when(linked, F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"),
            # Messages come before the results that hang on them; unordered calls' results last.
            F.when(linked, F.coalesce("level", F.lit((1 << 31) - 1))).otherwise(-1).alias("order_level"),
            F.when(linked, F.col("index")).otherwise(-1).alias("order_index"),
            F.size("calls").cast("long").alias("n_calls"), "n_invalid", "json",
        )


def dialogue_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``messages`` at 4 * turn, and for each

    * ``user`` row behind it (4 * turn + 1) an assistant message with the call
      u<turn> of ``search`` (query: the text, limit: its pieces between spaces)
      and, from turn 2 on, s<turn> of ``combine``, which needs u<turn> and
      s<turn - 2> (turns 2 and 3: u<turn - 2>), so that a dialogue's calls form
      a chain;
    * ``assistant`` row (4 * turn + 2) a tool message that answers u<turn - 1>.

    Null texts are no queries (an invalid call); null turns give no calls.
    """
    role, turn, text = F.col("role"), F.col("turn").cast("long"), F.col("text").cast("string")
    name = lambda letter, t: F.concat(F.lit(letter), t.cast("string"))
    ref = lambda t: F.create_map(F.lit("$ref"), t)
    limit = F.coalesce(F.size(F.split(text, " ", -1)), F.lit(0)).cast("long")
    search = F.to_json(F.struct(text.alias("query"), limit.alias("limit")), {"ignoreNullFields": "false"})
    left = F.when(turn >= 4, name("s", turn - 2)).otherwise(name("u", turn - 2))
    combine = F.to_json(F.struct(ref(left).alias("left"), ref(name("u", turn)).alias("right")))
    call = lambda i, tool, arguments: F.struct(i.alias("id"), F.lit(tool).alias("name"), arguments.alias("arguments"))
    one, two = call(name("u", turn), "search", search), call(name("s", turn), "combine", combine)
    asked = F.to_json(F.struct(F.when(turn >= 2, F.array(one, two)).otherwise(F.array(one)).alias("tool_calls")))
    answered = F.to_json(F.struct(name("u", turn - 1).alias("tool_call_id"), text.alias("content")), {"ignoreNullFields": "false"})
    message = lambda at, who, what: F.struct((4 * turn + at).alias("turn"), who.alias("role"), what.alias("text"))
    more = F.when((role == "user") & turn.isNotNull(), F.array(message(1, F.lit("assistant"), asked)))
    more = more.when((role == "assistant") & turn.isNotNull(), F.array(message(2, F.lit("tool"), answered)))
    own = message(0, role.cast("string"), text)
    every = F.concat(F.array(own), F.coalesce(more, F.slice(F.array(own), 1, 0)))
    return messages.select(F.col("conv_id"), F.explode(every).alias("m")).select("conv_id", "m.*")

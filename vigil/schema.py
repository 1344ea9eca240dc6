"""Column layouts that the library's tables share."""

from __future__ import annotations

from pyspark.sql import types as T

#: Parts of a transcript, in this order.
SOURCES = ("user_input", "tool_call", "tool_output", "stored_context", "assistant", "reasoning")
#: Scanned unless all content is asked for.
DEFAULT_SOURCES = SOURCES[:4]
#: Severity names by rank.
SEVERITIES = ("ignore", "low", "medium", "high")
RANK = {name: rank for rank, name in enumerate(SEVERITIES)}

ENTRY = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("entry_seq", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("command", T.StringType()),
    ]
)
PIECE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("piece_seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
RULE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("match_kind", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)
HINT = T.StructType(
    [
        T.StructField("key_kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)

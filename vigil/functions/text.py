"""Scalar text expressions."""

from __future__ import annotations

import json
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vigil.functions.automaton import buffers
from vigil.session import ship_package

#: Java regex pieces for ASCII classes (space, \t, \n, \v, \f, \r).
BLANK = r" \t\n\x0B\f\r"
NAME = r"A-Za-z0-9_-"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered; ``lower`` would also change letters beyond ASCII."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def quoted(text: str) -> str:
    """A Java regex that matches the text itself."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)


def any_of(words) -> str:
    return "|".join(map(quoted, words))


def starts_with_any(text: Column, words) -> Column:
    return text.rlike(f"^(?:{any_of(words)})")


#: Bytes, and texts, counted at once.
COUNTED, COUNTED_TEXTS = 1 << 20, 4096


def _entropy(texts: pa.Array) -> np.ndarray:
    """Bits a byte of each text. Bytes are counted part by part, so that it takes
    one step a byte and little memory however long a text is."""
    raw, at = buffers(texts)
    size = np.diff(at)
    total = np.zeros(len(size))
    for first in range(0, len(size), COUNTED_TEXTS):
        last = min(first + COUNTED_TEXTS, len(size))
        counts = np.zeros((last - first) * 256, np.int64)
        for start in range(at[first], at[last], COUNTED):
            end = min(start + COUNTED, at[last])
            low = int(np.searchsorted(at, start, "right")) - 1
            high = int(np.searchsorted(at, end, "left"))
            own = np.diff(np.clip(at[low : high + 1], start, end))
            found = np.bincount(np.repeat(np.arange(high - low) << 8, own) | raw[start:end])
            counts[(low - first) << 8 :][: len(found)] += found
        gain = counts * np.log2(np.maximum(counts, 1))
        total[first:last] = gain.reshape(-1, 256).sum(1)
    safe = np.maximum(size, 1)
    return np.maximum(0.0, np.log2(safe) - total / safe)


def entropy(text: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes, in bits a byte; empty and null give 0."""
    ship_package(SparkSession.active())
    return F.arrow_udf(lambda texts: pa.array(_entropy(texts)), "double")(text)


def _entropies(lists: pa.Array) -> pa.Array:
    bits = _entropy(lists.flatten())
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(bits))


def entropies(texts: Column) -> Column:
    """``entropy`` of each element of an array. The caller ships the package."""
    return F.arrow_udf(_entropies, "array<double>")(texts)


def table(rows: list[dict], kind: str) -> Column:
    """Rows as one constant array of structs, so that expressions over them
    stay one lambda instead of a branch for every row."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def first_place(text: Column, part: Column) -> Column:
    """Place of the first occurrence, 0-based; -1 where there is none."""
    return F.position(part, text) - 1


def single_line(text: Column) -> Column:
    """Line breaks and tabs as spaces."""
    return F.translate(text, "\n\r\t", "   ")


def window(text: Column, start: Column, size: Column, longest: int, context: int) -> Column:
    """Texts over ``longest`` bytes cut to the match and ``context`` characters on
    each side, with an ellipsis where something was cut."""
    n = F.length(text)
    at = F.least(start, n)
    first = F.greatest(at - context, F.lit(0))
    end = F.least(at + size + context, n)
    cut = F.concat(
        F.when(first > 0, "…").otherwise(""), F.substring(text, first + 1, end - first), F.when(end < n, "…").otherwise("")
    )
    return F.when(F.octet_length(text) <= longest, text).otherwise(cut)

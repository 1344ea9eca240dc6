"""One pass over a command's bytes that says which detectors can find something.

Every detector needs some literal: a flag, a key's marker, a provider's prefix
at the start of a token, an equals sign with a sensitive word. These literals and
all ignore and check rules, however many a user has, are one automaton (or
several of bounded size). Its walk gives each command a mask of the stages that
can fire, and the numbers of the check rules that match, so each detector runs
on its own few rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.automaton import Automaton, RuleBlock, rule_blocks, slices
from vigil.functions.detectors import REGISTRY
from vigil.session import ship_package

#: Bit of each stage in a mask, of check rules, and of commands that are there and not ignored.
STAGE_BITS = {stage: 1 << i for i, (stage, _) in enumerate(REGISTRY)}
CHECKED = 1 << len(REGISTRY)
LIVE = CHECKED << 1
FIRED = LIVE - 1
_SCHEME, _AT, _EQUALS, _IGNORED = (LIVE << i for i in range(1, 5))
SEEN = "struct<mask:int,checks:array<int>>"
_KIND = pa.struct([("mask", pa.int32()), ("checks", pa.list_(pa.int32()))])


def literals() -> list[tuple[str, str, int]]:
    """(match_kind, pattern, bits)."""
    bit = STAGE_BITS
    groups = (
        ("substring", bit["keys"], [*fixed.KEY_MARKERS, *[a + " " for a in fixed.SSH_ALGORITHMS]]),
        ("substring", bit["auth"], fixed.AUTH_PREFIXES),
        ("substring", bit["userinfo"], fixed.USERINFO_FLAGS),
        ("substring", bit["flags"], [*fixed.SECRET_FLAGS, "-p"]),
        ("token", bit["known"], [p for p, _ in fixed.PREFIX_HINTS]),
        ("substring", _SCHEME, ["://"]), ("substring", _AT, ["@"]), ("substring", _EQUALS, ["="]),
    )
    return [(kind, text, bits) for kind, bits, texts in groups for text in texts]


class Triggers:
    """The literals and rules of a scan."""

    def __init__(self, ignore: list[tuple[str, str]], check: list[tuple[str, str]]):
        own = literals()
        bits = [b for _, _, b in own] + [_IGNORED] * len(ignore) + [CHECKED] * len(check)
        self.bits = np.array(bits, np.int64)
        self.first_check = len(own) + len(ignore)
        self.blocks: list[RuleBlock] = list(rule_blocks([*[(k, p) for k, p, _ in own], *ignore, *check]))
        self.words = Automaton([w.encode() for w in fixed.SENSITIVE_WORDS], lowered=True)

    def seen(self, commands: pa.Array) -> pa.Array:
        """SEEN of each command. Null and ignored commands have mask 0."""
        out = [self._slice(*part) for part in slices(commands)]
        return pa.chunked_array(out, _KIND).combine_chunks() if out else pa.array([], _KIND)

    def _slice(self, commands: pa.Array, raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
        found = [b.matches(raw, bounds) for b in self.blocks]
        text, rule = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        mask = np.zeros(len(commands), np.int64)
        np.bitwise_or.at(mask, text, self.bits[rule])
        mask[np.asarray(commands.is_null())] |= _IGNORED
        mask[(mask & _SCHEME > 0) & (mask & _AT > 0)] |= STAGE_BITS["url"]
        # Sensitive words matter beside an equals sign only.
        assigned = np.flatnonzero((mask & (_EQUALS | _IGNORED)) == _EQUALS)
        if len(assigned):
            size = np.diff(bounds)[assigned]
            begin = np.concatenate(([0], np.cumsum(size)))
            inside = np.repeat(bounds[assigned] - begin[:-1], size) + np.arange(begin[-1])
            mask[assigned[np.unique(self.words.hits(raw[inside], begin)[0])]] |= STAGE_BITS["assign"]
        ignored = mask & _IGNORED > 0
        mask = np.where(ignored, 0, mask & FIRED | LIVE)
        checks = (rule >= self.first_check) & ~ignored[text]
        text, rule = text[checks], rule[checks]
        way = np.lexsort((rule, text))
        ends = np.searchsorted(text[way], np.arange(len(commands) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((rule[way] - self.first_check).astype(np.int32)))
        return pa.StructArray.from_arrays([pa.array(mask.astype(np.int32)), lists], fields=list(_KIND))


def seen(command: Column, ignore: list[tuple[str, str]], check: list[tuple[str, str]], stored: Triggers | None = None) -> Column:
    """SEEN of a column of commands, by automata made now or ``stored`` ones.
    The function counts as one that must not be worked out twice, so that
    filters on its result stay above it."""
    spark = SparkSession.active()
    ship_package(spark)
    sent = spark.sparkContext.broadcast(stored or Triggers(ignore, check))
    return F.arrow_udf(lambda c: sent.value.seen(c), SEEN).asNondeterministic()(command)

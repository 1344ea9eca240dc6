"""Removal of history entries: spans, range anti-join, guarded rewrite."""

from __future__ import annotations

import os
import stat
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.lines import block_of


def _spans(lines: DataFrame, joins: Column, to_next: bool) -> DataFrame:
    """lines (file, line, raw) with span_start and span_end: maximal runs of
    lines that belong together. ``joins``: whether a line belongs to the one
    above it or, with ``to_next``, to the one below. Windows take in a block of
    line numbers each; what runs on beyond a block comes from one row a block."""
    within = Window.partitionBy("file", "_block").orderBy("line")
    back = Window.partitionBy("file", "_block").orderBy(F.desc("line"))
    rows = lines.withColumns({"_block": block_of("line"), "_joins": F.coalesce(joins, F.lit(False))})
    joined = F.lag("_joins").over(within) if to_next else F.col("_joins")
    # No line above it in its block: whether it opens a span is settled below.
    rows = rows.withColumns({"_above": F.lag("line").over(within), "_joined": joined})
    inner = F.col("_above").isNotNull() & ~F.col("_joined")

    blocks = rows.groupBy("file", "_block").agg(
        F.min("line").alias("head"), F.max("line").alias("last"), F.min_by("_joins", "line").alias("head_joins"), F.max_by("_joins", "line").alias("tail_joins"),
        F.max(F.when(inner, F.col("line"))).alias("inner_open"), F.min(F.when(inner, F.col("_above"))).alias("inner_end"),
    )
    order = Window.partitionBy("file").orderBy("_block")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.lag("last").over(order)
    held = F.lag("tail_joins").over(order) if to_next else F.col("head_joins")
    blocks = blocks.withColumns({"above": above, "_head_opens": above.isNull() | ~held})
    blocks = blocks.withColumns({"opened": F.coalesce("inner_open", F.when(F.col("_head_opens"), F.col("head"))), "ended": F.when(F.col("_head_opens"), F.col("above")).otherwise(F.col("inner_end"))})
    whole = F.max("last").over(Window.partitionBy("file"))
    blocks = blocks.select("file", "_block", "_head_opens", F.max("opened").over(earlier).alias("_start"), F.coalesce(F.min("ended").over(later), whole).alias("_end"))

    rows = rows.join(blocks, ["file", "_block"])
    rows = rows.withColumn("_opens", F.when(F.col("_above").isNull(), F.col("_head_opens")).otherwise(~F.col("_joined")))
    start = F.max(F.when(F.col("_opens"), F.col("line"))).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.min(F.when(F.col("_opens"), F.col("_above"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(*lines.columns, F.coalesce(start, F.col("_start")).alias("span_start"), F.coalesce(end, F.col("_end")).alias("span_end"))


def shell_spans(lines: DataFrame) -> DataFrame:
    """lines with spans: runs joined by trailing backslashes. A carriage return
    behind a backslash ends the run, as the line as it is written counts."""
    return _spans(lines, F.endswith(F.col("raw"), F.lit("\\")), to_next=True)


def fish_spans(lines: DataFrame) -> DataFrame:
    """lines with spans: an entry's line and the indented lines below it."""
    return _spans(lines, F.startswith(F.col("raw"), F.lit(" ")), to_next=False)


def removal_candidates(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct physical spans that hold a finding: (file, span_start, span_end,
    line, full, redacted), the first finding of each span."""
    placed = findings.join(spans.select("file", "line", "span_start", "span_end"), ["file", "line"])
    order = F.struct("line", "entry_seq", "ord")
    best = placed.groupBy("file", "span_start").agg(
        F.max("span_end").alias("span_end"), F.min("line").alias("line"), F.min_by("command", order).alias("full"), F.min_by("redacted", order).alias("redacted")
    )
    return best.select("file", "span_start", "span_end", "line", "full", "redacted")


def remaining_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines of no span, by a sweep: lines and the edges of spans in one order,
    where a running sum says how many spans are open. It runs within blocks of
    line numbers; what is open at a block's start comes from one row a block, so
    neither a long file nor a long span is one task or one array."""
    edge = lambda at, change: F.struct(at.alias("line"), F.lit(change).alias("_change"))
    edges = spans.select("file", F.inline(F.array(edge(F.col("span_start").cast("long"), 1), edge(F.col("span_end").cast("long") + 1, -1))))
    rows = lines.select("file", F.col("line").cast("long").alias("line"), F.lit(0).alias("_change"), F.struct(*lines.columns).alias("_row"))
    rows = rows.unionByName(edges, allowMissingColumns=True).withColumn("_block", block_of("line"))
    above = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file", "_block").agg(F.sum("_change").alias("_sum"))
    carried = carried.select("file", "_block", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_carried"))
    within = Window.partitionBy("file", "_block").orderBy("line", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("_open", F.sum("_change").over(within)).where("_row IS NOT NULL").join(carried, ["file", "_block"])
    return swept.where(F.col("_open") + F.col("_carried") <= 0).select("_row.*")


@dataclass(frozen=True)
class Snapshot:
    """What a file held when it was read."""

    path: str
    data: bytes
    mode: int
    state: tuple

    @classmethod
    def take(cls, path: str) -> Snapshot:
        before = os.stat(path)
        with open(path, "rb") as file:
            data = file.read()
        after = os.stat(path)
        if _state(before) != _state(after):
            raise RuntimeError(f"{path} changed while it was read")
        return cls(path, data, stat.S_IMODE(after.st_mode), _state(after))

    def check(self) -> None:
        """Neither what the file system says nor a single byte may differ."""
        same = _state(os.stat(self.path)) == self.state
        if same:
            with open(self.path, "rb") as file:
                same = file.read() == self.data
        if not same:
            raise RuntimeError(f"{self.path} changed since it was read")


def _state(s: os.stat_result) -> tuple:
    return s.st_ino, s.st_size, s.st_mtime_ns


def without_lines(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes without the lines of the spans (from 1, ends included)."""
    lines = data.split(b"\n")
    last = len(lines)
    gone = {n for a, b in spans for n in range(a, min(b, last) + 1)}
    kept = [x for n, x in enumerate(lines, 1) if n not in gone]
    return b"\n".join(kept)


def rewrite(snapshot: Snapshot, data: bytes) -> None:
    """Replace the file in one step: a new file in its folder with the same
    permissions, flushed to disk, renamed over it if it is still as it was."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(snapshot.path) or ".")
    try:
        with os.fdopen(handle, "wb") as file:
            os.fchmod(file.fileno(), snapshot.mode)
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        snapshot.check()
        os.rename(temporary, snapshot.path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise

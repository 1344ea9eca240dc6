"""Stateful streams: fish entries across micro-batches, and groups of secrets
that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.session import ship_package
from vigil.sources.parsers import _stamp

ENTRY = "file string, at long, ts long, command string"
GROUP = "file string, token string, count long, severity_rank int, expired boolean"


def fish_entry_stream(lines: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """Stream of ENTRY from a stream of lines (file, at, raw), in the order of
    ``at`` within a file. An entry is complete when the next one opens, or when
    its file had no line for ``ttl``; the open one is all the state a file has. A
    file that begins anew closes it, too."""
    ship_package(lines.sparkSession)
    wait = _milliseconds(ttl)

    def entries(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, opened, ts, command = state.get if state.exists else (-1, -1, None, None)
        done: list[tuple] = []
        if state.hasTimedOut:
            if opened >= 0:
                done.append((key[0], opened, ts, command))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("at", kind="stable")
            for at, raw in zip(rows["at"].tolist(), rows["raw"].tolist()):
                line = raw.removesuffix("\r")
                if at < last:  # rotated or truncated
                    if opened >= 0:
                        done.append((key[0], opened, ts, command))
                    opened, ts, command = -1, None, None
                last = at
                if line.startswith("- cmd: "):
                    if opened >= 0:
                        done.append((key[0], opened, ts, command))
                    opened, ts, command = at, None, line[7:]
                elif line.startswith("  when: ") and opened >= 0:
                    ts = _stamp(line[8:])
            state.update((last, opened, ts, command))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(done, columns=["file", "at", "ts", "command"]).astype({"at": "int64", "ts": "Int64"})

    slim = lines.select("file", "at", "raw").groupBy("file")
    return slim.applyInPandasWithState(entries, ENTRY, "last long, opened long, ts long, command string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def group_stream(findings: DataFrame, ttl: str = "1 day") -> DataFrame:
    """Stream of GROUP in update mode from findings (file, token,
    severity_rank): running count and highest severity of each secret in a file.
    A group without findings for ``ttl`` is told a last time, as expired, and
    leaves the state, which therefore holds the groups of one ``ttl`` at most."""
    wait = _milliseconds(ttl)

    def groups(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, rank = state.get if state.exists else (0, 0)
        expired = state.hasTimedOut
        if expired:
            state.remove()
        else:
            for part in batches:
                count, rank = count + len(part), max(rank, int(part["severity_rank"].max()))
            state.update((count, rank))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame([(*key, count, rank, expired)], columns=["file", "token", "count", "severity_rank", "expired"])

    keyed = findings.select("file", "token", F.col("severity_rank").cast("int")).groupBy("file", "token")
    return keyed.applyInPandasWithState(groups, GROUP, "count long, severity_rank int", "update", GroupStateTimeout.ProcessingTimeTimeout)


_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * _UNITS[unit.removesuffix("s")]

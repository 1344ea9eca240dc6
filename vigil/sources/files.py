"""Readers of history files and transcripts as Python data sources.

Spark's file listing hides dotfiles, which most histories are, so paths are
found on the driver and read by a data source of our own. Small files share a
partition; a file over BIN_BYTES becomes ranges of bytes, which own the lines that
begin in them. A first pass over such files counts each range's lines and
entries, and their running sums number what the second pass reads, so a long
file has the same rows however it is cut. Paths must be readable where the tasks
run.
"""

from __future__ import annotations

import json
import os
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vigil.session import ship_package
from vigil.sources import parsers

BIN_BYTES = 32 << 20
ENTRIES = "file string, file_ord long, line long, entry_seq long, ts long, raw string, command string, error string"
PIECES = "file string, file_ord long, line long, piece_seq long, source string, text string, malformed long, error string"
COUNTS = "part long, lines long, rows long"


class Range(InputPartition):
    """Parts of files: (place, path, start, end, lines before, entries before,
    number of the part). Without an end a file is read whole."""

    def __init__(self, parts: list[list]):
        self.parts = parts


def ranges(paths: list[str], limit: int, splits) -> list[list[list]]:
    """Parts by partition: small files together, long ones that ``splits`` says
    can be cut in parts of ``limit`` bytes."""
    out: list[list[list]] = []
    room = number = 0
    for place, path in enumerate(paths):
        size = os.path.getsize(path) if os.path.exists(path) else 0
        if size > limit and splits(path):
            cuts = list(range(0, size, limit))
            out += [[[place, path, a, min(size, a + limit), 0, 0, number + i]] for i, a in enumerate(cuts)]
            number, room = number + len(cuts), 0
            continue
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append([place, path, 0, None, 0, 0, number])
        number, room = number + 1, room - size
    return out


def lines_of(path: str, start: int, end: int | None, opens: bytes | None = None) -> tuple[bytes, int]:
    """(bytes, lines) of a file's lines that begin in a range. With ``opens``
    what follows up to the next line that begins so comes too, uncounted."""
    with open(path, "rb") as file:
        if end is None:
            data = file.read()
            return data, data.count(b"\n") + 1
        if start:
            file.seek(start - 1)
            file.readline()  # the rest of a line that began before
        at = file.tell()
        if at >= end:
            return b"", 0
        data = file.read(end - at)
        if not data.endswith(b"\n"):
            data += file.readline()
        own, rest = data.count(b"\n") + (not data.endswith(b"\n")), []
        while opens and (line := file.readline()) and not line.startswith(opens):
            rest.append(line)
        return data + b"".join(rest), own


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.parts = json.loads(options["parts"])
        self.fail = options.get("fail", "false") == "true"
        self.count = options.get("count", "false") == "true"

    def partitions(self):
        return [Range(parts) for parts in self.parts] or [Range([])]

    def read(self, partition):
        for place, path, start, end, lines, rows, number in partition.parts:
            try:
                data, own = lines_of(path, start, end, self.opens(path))
            except OSError as error:
                if self.fail:
                    raise
                # A file that is gone or closed to us is skipped; other troubles are told.
                if not self.count and not isinstance(error, (FileNotFoundError, PermissionError)):
                    yield self.trouble(place, path, error.strerror or str(error))
                continue
            found = self.rows(place, path, data, own, lines, rows)
            if self.count:
                yield number, own, sum(1 for _ in found)
            else:
                yield from found


class _HistoryReader(_Reader):
    def opens(self, path):
        return b"- cmd: " if parsers.history_kind(path) == "fish" else None

    def trouble(self, place, path, error):
        return path, place, None, None, None, None, None, error

    def rows(self, place, path, data, own, lines, rows):
        seq = rows
        for line, ts, raw, command in parsers.entries(path, data):
            if line <= own:  # what begins later is the next part's
                yield path, place, lines + line, seq, ts, raw, command, None if command is not None else "oversized"
                seq += 1


class _TranscriptReader(_Reader):
    def opens(self, path):
        return None

    def trouble(self, place, path, error):
        return path, place, None, None, None, None, 0, error

    def rows(self, place, path, data, own, lines, rows):
        found, malformed = parsers.pieces(parsers.path_format(path), data)
        for seq, (line, source, text) in enumerate(found, rows):
            yield path, place, lines + line, seq, source, text, 0, None
        if not self.count:
            yield path, place, None, None, None, None, malformed, None


class _Source(DataSource):
    def schema(self):
        return COUNTS if self.options.get("count", "false") == "true" else self.rows


class HistorySource(_Source):
    rows = ENTRIES

    @classmethod
    def name(cls):
        return "vigil_history"

    def reader(self, schema):
        return _HistoryReader(self.options)


class TranscriptSource(_Source):
    rows = PIECES

    @classmethod
    def name(cls):
        return "vigil_transcripts"

    def reader(self, schema):
        return _TranscriptReader(self.options)


def _load(spark: SparkSession, source, parts: list[list[list]], fail: bool, count: bool = False) -> DataFrame:
    options = {"parts": json.dumps(parts), "fail": str(fail).lower(), "count": str(count).lower()}
    return spark.read.format(source.name()).options(**options).load()


def _read(spark: SparkSession, source, paths: list[str], fail: bool, limit: int, splits) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(source)
    parts = ranges(paths, limit, splits)
    cut = [p for group in parts for p in group if p[3] is not None]
    if cut:
        # One row for each part of a long file, that is for each 32 MB.
        counts = {r["part"]: (r["lines"], r["rows"]) for r in _load(spark, source, [[p] for p in cut], fail, count=True).collect()}
        for path in dict.fromkeys(p[1] for p in cut):
            own = [p for p in cut if p[1] == path]
            for i in (0, 1):
                for p, before in zip(own, accumulate((counts.get(p[6], (0, 0))[i] for p in own), initial=0)):
                    p[4 + i] = before
    return _load(spark, source, parts, fail)


def read_histories(spark: SparkSession, paths: list[str], fail: bool = False, limit: int = BIN_BYTES) -> DataFrame:
    """Entries of history files; rows with error 'oversized' stand for skipped
    lines, those with another error for files that couldn't be read. Neither
    has a command."""
    return _read(spark, HistorySource, paths, fail, limit, lambda path: True)


def read_transcripts(spark: SparkSession, paths: list[str], fail: bool = True, limit: int = BIN_BYTES) -> DataFrame:
    """Pieces of transcripts; each file, or part of a long one, also has one row
    without text that holds its number of malformed records. Documents that are
    one JSON value can't be cut."""
    return _read(spark, TranscriptSource, paths, fail, limit, lambda path: parsers.path_format(path) not in ("json", "gemini_json"))


def environment(spark: SparkSession, variables: dict[str, str]) -> DataFrame:
    """Entries KEY=value of the variables that aren't empty."""
    rows = [("<env>", 0, i + 1, i, None, f"{k}={v}", f"{k}={v}", None) for i, (k, v) in enumerate(variables.items()) if v]
    return spark.createDataFrame(rows, ENTRIES)


def stream_text(spark: SparkSession, data: bytes, file: str = "<stdin>") -> DataFrame:
    """Entries of standard input, which is read on the driver."""
    rows = [(file, 0, n, i, ts, raw, c, None if c is not None else "oversized") for i, (n, ts, raw, c) in enumerate(parsers.shell(data))]
    return spark.createDataFrame(rows, ENTRIES)


def history_text(spark: SparkSession, path: str, data: bytes) -> DataFrame:
    """Entries of a history whose bytes the driver holds, by its path's kind."""
    rows = [(path, 0, n, i, ts, raw, c, None if c is not None else "oversized") for i, (n, ts, raw, c) in enumerate(parsers.entries(path, data))]
    return spark.createDataFrame(rows, ENTRIES)

"""Histories that grow, as a stream of their lines.

Offsets are (inode, byte) of each file and always behind a line feed, so a batch
is whole lines, fixed by its two offsets: run again after a failure, it holds the
same lines, and a restart goes on where the last batch ended. A file with another
inode, or one shorter than what was read, was rotated or truncated and begins
anew at its first byte; what was written between the last batch and the rotation
stays in the file under its other name. Paths must be readable where the tasks
run; a file that isn't there yet joins once it is.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from vigil.session import ship_package
from vigil.sources.parsers import decode

LINES = "file string, at long, raw string"
#: Bytes of a file in one partition, about.
PART_BYTES = 32 << 20
_BLOCK = 1 << 16


def whole_lines(path: str) -> tuple[int, int] | None:
    """(inode, bytes up to the last line feed) of a file; None without one."""
    try:
        with open(path, "rb") as file:
            state = os.fstat(file.fileno())
            end = state.st_size
            while end > 0:
                start = max(0, end - _BLOCK)
                file.seek(start)
                found = file.read(end - start).rfind(b"\n")
                if found >= 0:
                    return state.st_ino, start + found + 1
                end = start
            return state.st_ino, 0
    except OSError:
        return None


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.part_bytes = int(options.get("part_bytes", str(PART_BYTES)))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        found = {path: whole_lines(path) for path in self.paths}
        return {"files": {path: list(at) for path, at in found.items() if at}}

    def partitions(self, start: dict, end: dict):
        out = []
        for path, (inode, stop) in end["files"].items():
            before, at = start["files"].get(path, (inode, 0))
            begin = at if before == inode and at <= stop else 0
            out += [Part(path, a, min(stop, a + self.part_bytes)) for a in range(begin, stop, self.part_bytes)]
        return out

    def read(self, partition):
        with open(partition.path, "rb") as file:
            at = partition.start
            if at:  # a part owns the lines that begin in it
                file.seek(at - 1)
                at += len(file.readline()) - 1
            while at < partition.end and (line := file.readline()):
                yield partition.path, at, decode(line.removesuffix(b"\n"))
                at += len(line)


class TailSource(DataSource):
    @classmethod
    def name(cls):
        return "vigil_tail"

    def schema(self):
        return LINES

    def streamReader(self, schema):
        return TailReader(self.options)


def tail(spark: SparkSession, paths: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """A stream of (file, at, raw): the lines of files as they grow, with the
    byte where each begins."""
    ship_package(spark)
    spark.dataSource.register(TailSource)
    return spark.readStream.format("vigil_tail").option("paths", json.dumps(paths)).option("part_bytes", str(part_bytes)).load()

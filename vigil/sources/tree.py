"""Files below folders, listed and read by Spark's tasks.

The driver only looks at the roots' first levels and hands out subtrees; what
lies below is listed where it is read, excluded, given to roots and deduplicated
as a table, so no list of files passes through the driver. Folders must be
readable where the tasks run.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vigil.operators.deep import outside, root_of
from vigil.session import ship_package
from vigil.sources import files, parsers

LISTED = "path string, size long"
#: Levels of folders below a root that the driver looks at, and folders it hands out at most.
LEVELS, SUBTREES = 2, 1000


def subtrees(root: str, levels: int = LEVELS, most: int = SUBTREES) -> list[tuple[str, bool]]:
    """(folder, whether all below belongs to it): what can be listed apart."""
    open_, out = [root], []
    for _ in range(levels):
        below = []
        for folder in open_:
            try:
                inner = [e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)]
            except OSError:
                inner = []
            if len(out) + len(below) + len(inner) >= most:
                out.append((folder, True))
            else:
                out.append((folder, False))
                below += inner
        open_ = below
    return out + [(f, True) for f in open_]


class Subtrees(InputPartition):
    def __init__(self, folders: list[list]):
        self.folders = folders


def _listed(path: str) -> Iterator[tuple[str, int]]:
    """A file that is regular: links and other things are left alone."""
    try:
        state = os.lstat(path)
    except OSError:
        return
    if stat.S_ISREG(state.st_mode):
        yield path, state.st_size


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots, self.parts = json.loads(options["roots"]), int(options["parts"])

    def partitions(self):
        found: list[list] = []
        for root in self.roots:
            found += [[f, whole] for f, whole in subtrees(root)] if os.path.isdir(root) else [[root, None]]
        return [Subtrees(found[i :: self.parts]) for i in range(min(self.parts, len(found)))] or [Subtrees([])]

    def read(self, partition):
        for folder, whole in partition.folders:
            if whole is None:  # a file that a root names, be it a link
                if os.path.isfile(folder) and os.access(folder, os.R_OK):
                    yield folder, os.stat(folder).st_size
                continue
            for at, below, names in os.walk(folder):
                if not whole:
                    below.clear()
                for name in names:
                    yield from _listed(os.path.join(at, name))


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "vigil_tree"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return TreeReader(self.options)


def listed(spark: SparkSession, roots: list[str], excluded: list[str] = (), parts: int | None = None) -> DataFrame:
    """(path, size, root, root_ord) of all files below the roots, once each: the
    longest root of a file counts, the first of equals. ``excluded`` paths, and
    what lies below them, drop out; folders closed to us are passed over."""
    ship_package(spark)
    spark.dataSource.register(TreeSource)
    parts = parts or spark.sparkContext.defaultParallelism * 4
    found = spark.read.format("vigil_tree").option("roots", json.dumps(list(dict.fromkeys(roots)))).option("parts", str(parts)).load()
    found = found.groupBy("path").agg(F.max("size").alias("size"))
    if excluded:
        found = outside(found, spark.createDataFrame([(x,) for x in excluded], "root string"))
    owners = root_of(found.select("path"), spark.createDataFrame(list(enumerate(roots)), "root_ord int, root string"))
    return found.join(owners, "path")


def pieces_of(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Transcript pieces (``files.PIECES``) of listed files (path), read where
    they are dealt to; file_ord is null, as such files have no order."""
    spark = listing.sparkSession
    ship_package(spark)
    names = [c.split()[0] for c in files.PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as file:
                        found, malformed = parsers.pieces(parsers.path_format(path), file.read())
                    rows = [(path, None, line, seq, source, text, 0, None) for seq, (line, source, text) in enumerate(found)]
                    rows.append((path, None, None, None, None, None, malformed, None))
                except OSError as error:
                    rows = [(path, None, None, None, None, None, 0, error.strerror or str(error))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    dealt = listing.select("path").repartition(tasks or spark.sparkContext.defaultParallelism * 4, "path")
    return dealt.mapInArrow(read, files.PIECES)

"""Hard negatives by bit-sliced integer inner products.

Components become integers floor(scale * x). A row's score for an anchor is
their inner product. An anchor's positives are its first rows of the same label;
for each positive, its negatives are the first rows of other labels whose score
lies between ``low`` and ``high`` per cent of the positive's.

Rows are cut into bit-planes. A block of anchors meets a block of rows one
plane at a time, the most significant first: what the planes seen so far add up
to, and what the others can still add, is an interval for each score. A pair
goes when its interval can't reach the window any more or can't beat the
candidates found before; once few pairs are left only these go on.

Anchors are streamed through the driver and broadcast in blocks of bounded
bytes; each block passes over all rows in one job for positives and one for
negatives. A task keeps the first few candidates of each anchor, and Spark sorts
what the tasks kept. No row ever meets another one in a join, so copies of a
vector and large labels stay where they are.

A null label, a null vector and null or non-finite components keep a row out, and
so does a vector shorter than the longest. Rows that repeat are rows of their
own: an anchor leaves out itself, not its copies. Ties go to smaller ids, nulls
last. Labels without other rows give no positives, and empty tables no rows.
Scores of 2**53 or more in absolute value raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.vectors import matrix, taking_part
from vigil.session import materialize, new_path, ship_package

#: Bytes of anchors' components in one broadcast block.
BLOCK_BYTES = 4 << 20
#: Rows that a task takes first, before it knows any candidates, and at most.
FIRST_ROWS, MOST_ROWS = 128, 2048
#: Pairs worked on at once.
PAIRS = 1 << 20
#: Pairs go on one by one when fewer than one in so many is left.
SPARSE = 12
#: Rows of each partition.
PARTITION_ROWS = 1 << 16

OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Planes:
    """Bit-planes of some rows, the most significant first."""

    def __init__(self, rows: np.ndarray, bits: int, kind):
        shifted = rows + (1 << (bits - 1))
        self.offset = 1 << (bits - 1)
        self.weights = [1 << b for b in range(bits - 1, -1, -1)]
        self.planes = [((shifted >> b) & 1).astype(kind) for b in range(bits - 1, -1, -1)]


class Anchors:
    """A block of anchors: integer components, and what planes can still add."""

    def __init__(self, x: np.ndarray, kind):
        self.x = x.astype(kind)
        self.total = x.sum(1).astype(kind)
        self.above = np.where(x > 0, x, 0).sum(1).astype(kind)
        self.below = np.where(x < 0, x, 0).sum(1).astype(kind)


def survivors(anchors: Anchors, which: np.ndarray, planes: Planes, rows: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, allowed: np.ndarray | None = None):
    """(index into which, index into rows, exact score) of all pairs with a score
    in [floor, ceiling] of the anchor. ``allowed`` says which pairs take part."""
    x, above, below = anchors.x[which], anchors.above[which], anchors.below[which]
    known = np.repeat(-anchors.total[which, None] * planes.offset, len(rows), axis=1)
    a = r = value = None
    for weight, plane in zip(planes.weights, planes.planes):
        rest = weight - 1
        need, most = floor - above * rest, ceiling - below * rest
        if a is None:
            known += (x @ plane[rows].T) * x.dtype.type(weight)
            alive = (known >= need[:, None]) & (known <= most[:, None])
            if allowed is not None:
                alive &= allowed
            if not rest or np.count_nonzero(alive) * SPARSE < alive.size:
                a, r = np.nonzero(alive)
                value = known[a, r]
        else:
            value = value + np.einsum("ij,ij->i", x[a], plane[rows[r]]) * x.dtype.type(weight)
            alive = (value >= need[a]) & (value <= most[a])
            a, r, value = a[alive], r[alive], value[alive]
    return a, r, value.astype(np.int64)


class First:
    """The first ``count`` candidates of each group: highest score, then
    smallest id, nulls last."""

    def __init__(self, groups: int, count: int):
        self.groups, self.count = groups, count
        none = np.zeros(0, np.int64)
        self.held = [none, none, none, none, none]  # group, score, id, whether it is null, mark
        self.floor = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, mark: np.ndarray) -> None:
        if not len(group):
            return
        held = [np.concatenate(pair) for pair in zip(self.held, (group, score, ids, null, mark))]
        way = np.lexsort((held[2], held[3], -held[1], held[0]))
        group = held[0][way]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        self.held = [h[way[place < self.count]] for h in held]
        last = place == self.count - 1
        self.floor[group[last]] = held[1][way[last]]


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(ids, null ids, labels, components) of rows, few at first."""
    size = FIRST_ROWS
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, size)
            start += size
            size = min(MOST_ROWS, size * 2)
            ids = part.column("id")
            null = np.asarray(ids.is_null()).astype(np.int64)
            yield np.asarray(ids.fill_null(0)), null, np.asarray(part.column("label")), matrix(part.column("x"), length, np.int64)


class HardNegatives:
    """The operator over a table of ids, labels and vectors."""

    def __init__(self, spark: SparkSession, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = BLOCK_BYTES):
        ship_package(spark)
        self.spark, self.scale, self.positives, self.negatives = spark, scale, positives, negatives
        self.low, self.high, self.block_bytes = low, high, block_bytes

    def mine(self, df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
        """OUTPUT for the anchors, the rows of ``df`` for which ``anchor`` is true."""
        spark = self.spark
        part, length = taking_part(df, vector, F.col(label).isNotNull())
        scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * self.scale))
        rows = part.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
        # What a row costs is its products, not its way to another task, so rows are dealt evenly.
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-part.count() // PARTITION_ROWS))
        rows = materialize(spark, rows, "negative-rows")
        size = rows.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0] or 0
        bits = max(2, int(size).bit_length() + 1)
        if length * (size + 1) ** 2 * 4 >= 1 << 53:
            raise ValueError("components are too large for exact scores")
        kind = np.float32 if length * (size + 1) ** 2 * 4 < 1 << 24 else np.float64
        path = new_path(spark, "negatives")
        spark.createDataFrame([], OUTPUT).write.parquet(path)
        dealt = rows.select("id", "label", "x").repartition(partitions)
        limit = max(1, self.block_bytes // max(8, 8 * length))
        for block in _blocks(rows.where("anchor").select("id", "label", "x"), limit):
            self._mine(dealt, block, length, bits, kind).write.mode("append").parquet(path)
        return spark.read.schema(OUTPUT).parquet(path)

    def _mine(self, rows: DataFrame, block: list, length: int, bits: int, kind) -> DataFrame:
        spark, count, most, low, high = self.spark, self.positives, self.negatives, self.low, self.high
        ids = np.array([r["id"] for r in block], np.int64)
        labels = np.array([r["label"] for r in block], np.int64)
        x = np.array([r["x"] for r in block], np.int64).reshape(len(block), length)
        sent = spark.sparkContext.broadcast((ids, labels, x))

        def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, x = sent.value
            anchors, first = Anchors(x, kind), First(len(ids), count + 1)
            by_label = np.argsort(labels, kind="stable")
            sorted_labels = labels[by_label]
            for own, null, label, components in _chunks(batches, length):
                planes = Planes(components, bits, kind)
                for one in np.unique(label):
                    inside = np.flatnonzero(label == one)
                    group = by_label[slice(*np.searchsorted(sorted_labels, [one, one + 1]))]
                    for which in _cut(group, len(inside)):
                        a, r, score = survivors(anchors, which, planes, inside, first.floor[which], np.full(len(which), np.inf))
                        a, r = which[a], inside[r]
                        same = (own[r] == ids[a]) & (null[r] == 0)
                        same[same] = (components[r[same]] == x[a[same]]).all(1)
                        first.add(a, score, own[r], null[r], same.astype(np.int64))
            group, score, found, null, same = first.held
            yield pa.record_batch([pa.array(group), pa.array(score), pa.array(found, mask=null == 1), pa.array(same)], ["group", "score", "id", "same"])

        near = rows.mapInArrow(positives, "group long, score long, id long, same long")
        near = _first(near, count + 1).toArrow()  # six rows an anchor of the block
        group, score, same = (np.asarray(near[c]) for c in ("group", "score", "same"))
        found, null = np.asarray(near["id"].fill_null(0)), np.asarray(near["id"].is_null())
        way = np.lexsort((found, null, -score, group))
        group, score, same, found, null = group[way], score[way], same[way], found[way], null[way]
        # The anchor itself is one of the rows that equal it.
        self_at = np.flatnonzero(same)
        keep = np.ones(len(group), bool)
        keep[self_at[np.unique(group[self_at], return_index=True)[1]]] = False
        group, score, found, null = group[keep], score[keep], found[keep], null[keep]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        inside = place < count
        group, place, score, found, null = group[inside], place[inside], score[inside], found[inside], null[inside]
        least, greatest = np.full((len(ids), count), np.inf), np.full((len(ids), count), -np.inf)
        at_least, at_most = -((-low * score) // 100), (high * score) // 100
        real = at_least <= at_most
        least[group[real], place[real]], greatest[group[real], place[real]] = at_least[real], at_most[real]
        positive = np.zeros((3, len(ids), count), np.int64)
        positive[:, group, place] = found, null, score
        windows = spark.sparkContext.broadcast((least, greatest, positive))

        def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, x = sent.value
            least, greatest, positive = windows.value
            anchors, first = Anchors(x, kind), First(len(ids) * count, most)
            everyone = np.flatnonzero((least <= greatest).any(1))
            for own, null, label, components in _chunks(batches, length):
                planes, every = Planes(components, bits, kind), np.arange(len(own))
                for which in _cut(everyone, len(own)):
                    floor = np.maximum(least[which], first.floor.reshape(-1, count)[which])
                    a, r, score = survivors(anchors, which, planes, every, floor.min(1), greatest[which].max(1), labels[which, None] != label[None, :])
                    for k in range(count):
                        inside = (score >= floor[a, k]) & (score <= greatest[which[a], k])
                        b, s = which[a[inside]], r[inside]
                        first.add(b * count + k, score[inside], own[s], null[s], np.zeros(len(b), np.int64))
            group, score, found, null, _ = first.held
            a, k = group // count, group % count
            yield pa.record_batch(
                [pa.array(group), pa.array(score), pa.array(found, mask=null == 1), pa.array(ids[a]), pa.array(positive[0, a, k], mask=positive[1, a, k] == 1), pa.array(positive[2, a, k])],
                ["group", "score", "id", "anchor_id", "positive_id", "positive_score"],
            )

        far = rows.mapInArrow(negatives, "group long, score long, id long, anchor_id long, positive_id long, positive_score long")
        ranked = _first(far, most)
        return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _first(candidates: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each group; a group has as many rows of each task."""
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _cut(which: np.ndarray, rows: int) -> list[np.ndarray]:
    """Parts of ``which`` that make at most PAIRS pairs with so many rows."""
    step = max(1, PAIRS // max(1, rows))
    return [which[i : i + step] for i in range(0, len(which), step)]


def _blocks(anchors: DataFrame, limit: int) -> Iterator[list]:
    held = []
    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == limit:
            yield held
            held = []
    if held:
        yield held

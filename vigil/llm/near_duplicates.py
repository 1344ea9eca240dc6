"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set are its distinct word shingles (its whole word sequence where
it has fewer words). A signature is SYMBOLS least hashes, one byte of each.
Signatures are cut into CHUNKS; two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) symbols have, by the pigeonhole principle, a chunk with
at most ERRORS = 1 differing symbol. So each chunk is entered in the index
once for every symbol that may be wrong, without it: equal entries find every
pair below that distance for certain, and most pairs beyond it. At a
similarity of exactly 0.8 a symbol differs with probability 0.2, so a chunk
of 8 agrees up to one error with probability 0.503 and all 16 chunks miss
with probability 1.4e-5; above 0.8 the miss rate falls fast. Pairs from equal
entries are compared by their signatures, and those within FAR symbols
(five standard deviations beyond 0.8) are confirmed on their full sets.

No group is expanded into all its pairs:

1. Documents with equal sets become one class, whose representative is its
   least doc_id; only representatives go on.
2. Entries with one member drop out in a streaming pass over sorted entries,
   which also pairs each member with the entry's least member; each document
   keeps its least hub within reach, the full sets confirm, and confirmed
   links make first components. A group of near copies collapses here.
3. Once or more (ROUNDS), each document with bucket mates within reach in other components tries
   the nearest of them, which is one pair a document; confirmed links merge
   components. Documents without such mates are done.
4. Entries whose members lie in one component have nothing left to find. In the
   others a worker compares signatures across components only, in blocks of
   bounded size (a larger entry is split into pairs of blocks), and notes which
   documents of a smaller component are within reach of which larger one. Each
   is then held against all members of that component by full sets, block by
   block inside a worker. So every pair that shares an entry is either in one
   component already or has been checked, and pairs never become rows.

Null or wordless texts have an empty set (n_shingles 0) and link with nothing.
Rows without doc_id are not linked: component_id null, kept. Rows that repeat a
doc_id count as one node. Ties need no rule, as the least doc_id decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bitfilter
from vigil.llm.components import components
from vigil.llm.kernels import NOT_SPACE, mix, owner, shards, text_buffers, words
from vigil.session import materialize, ship_package

SYMBOLS, CHUNKS = 128, 16
WIDTH = SYMBOLS // CHUNKS
#: Signatures that differ in more symbols are taken as less than 0.8 similar.
FAR = 50
#: Rounds in which every document tries the nearest one of another component.
ROUNDS = 1
#: Documents on either side of a block whose full sets a worker compares.
SIDE = 256
#: Members of an entry that a worker compares at once.
BLOCK = 4096
#: Parity bits of a set at most. Larger sets pass the bound more often; it stays a bound.
PARITY_BITS = 8192
#: Pairs whose parities a worker compares at once.
PAIRS = 1 << 15

_DRAW = np.random.default_rng(20240501)
_FACTOR = (_DRAW.integers(0, 1 << 32, SYMBOLS, np.uint32) | np.uint32(1)).astype(np.uint32)
_OFFSET = _DRAW.integers(0, 1 << 32, SYMBOLS, np.uint32)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of every text, sorted within it."""
    _, _, code, at = words(raw, bounds, NOT_SPACE)
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(size)), size)
    first = np.repeat(at[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    value = np.full(len(first), np.uint64(n))
    room = np.repeat(at[1:], size)
    for k in range(n):
        there = first + k < room
        step = code[np.minimum(first + k, len(code) - 1)] if len(code) else value
        value = np.where(there, mix(value * np.uint64(0x9E3779B97F4A7C15) + step), value)
    order = np.argsort(value)
    if len(size) < 1 << 16:  # a stable sort of 16-bit keys takes linear time
        order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(text[order], kind="stable")]
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(size) + 1))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (bytes by SYMBOLS) of the sets that aren't empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    short = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
    out = np.zeros((len(starts), SYMBOLS), np.uint8)
    for k in range(SYMBOLS if len(starts) else 0):
        least = np.minimum.reduceat(short * _FACTOR[k] + _OFFSET[k], starts).astype(np.uint64)
        out[:, k] = (mix(least + np.uint64(k << 32)) & np.uint64(255)).astype(np.uint8)
    return out


def entries(signature: np.ndarray, errors: int = 1) -> np.ndarray:
    """Index entries of each signature: one for every chunk and ``errors`` omitted symbols."""
    parts = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.uint64)
    weights = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    each = mix(parts * np.uint64(257) + weights) * weights
    omitted = np.array(list(combinations(range(WIDTH), errors)))
    left = each.sum(2, keepdims=True) - each[:, :, omitted].sum(3)
    place = np.arange(CHUNKS * len(omitted), dtype=np.uint64).reshape(1, CHUNKS, -1) << np.uint64(8)
    return mix(left ^ mix(place + np.uint64(1))).reshape(len(signature), -1)


def parities(value: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For every set the parities of its elements by slot: a power of two of
    slots, twice the elements or more up to PARITY_BITS."""
    size = np.diff(bounds)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), 64, PARITY_BITS)
    ends = np.cumsum(bits)
    text = owner(bounds)
    slot = (value & (bits[text] - 1).astype(np.uint64)).astype(np.int64) + (ends - bits)[text]
    odd = np.packbits((np.bincount(slot, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[(b - w) // 8 : b // 8] for b, w in zip(ends, bits)]


class Bound:
    """Tells pairs of sets apart that can't be similar enough, from their sizes
    and parities. Folding a longer row of parities in halves gives the shorter
    row of the same set, so sets with different numbers of slots compare."""

    def __init__(self, n: np.ndarray, parity: list[bytes], parts: int):
        self.n, self.parity, self.parts = n, parity, parts
        self.width = np.array([len(x) for x in parity], np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``width`` bytes, row of each set)."""
        if width not in self.rows:
            own = np.flatnonzero(self.width == width)
            made, where = [np.frombuffer(b"".join(self.parity[i] for i in own), np.uint64).reshape(len(own), width // 8)], [own]
            if (self.width > width).any():
                rows, at = self._folded(2 * width)
                longer = np.flatnonzero(self.width > width)
                half = width // 8
                made.append(rows[at[longer], :half] ^ rows[at[longer], half:])
                where.append(longer)
            at = np.full(len(self.n), -1)
            at[np.concatenate(where)] = np.arange(sum(map(len, where)))
            self.rows[width] = np.concatenate(made), at
        return self.rows[width]

    def passes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs of sets (x[k], y[k]) may be similar enough."""
        parts, n = self.parts, self.n
        out = 100 * np.minimum(n[x], n[y]) >= parts * np.maximum(n[x], n[y])
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width[out]):
            rows, at = self._folded(int(w))
            some = np.flatnonzero(out & (width == w))
            for k in range(0, len(some), PAIRS):
                i = some[k : k + PAIRS]
                apart = np.bitwise_count(rows[at[x[i]]] ^ rows[at[y[i]]]).sum(1, dtype=np.int64)
                out[i] = (100 + parts) * apart <= (100 - parts) * (n[x[i]] + n[y[i]])
        return out


class NearDuplicates:
    def __init__(self, spark: SparkSession, shingle: int = 5, similarity: float = 0.8, errors: int = 1):
        """errors: symbols of a chunk that an index entry may leave out."""
        ship_package(spark)
        self.spark, self.shingle, self.errors = spark, shingle, errors
        self.parts = round(similarity * 100)

    def _signed(self, docs: DataFrame) -> DataFrame:
        """(id, n, a, b, signature, parity) of every document: n shingles; a and b hash the set."""
        n = self.shingle
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("signature", pa.binary()), ("parity", pa.binary())])

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in shards(batch, "body"):
                    value, bounds = shingle_sets(*text_buffers(part.column("body")), n)
                    size = np.diff(bounds)
                    full = size > 0
                    a, b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                    if full.any():
                        a[full] = np.add.reduceat(mix(value), bounds[:-1][full])
                        b[full] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
                    rows = iter(signatures(value, bounds))
                    binary = pa.array([next(rows).tobytes() if f else None for f in full], pa.binary())
                    columns = [part.column("id"), pa.array(size, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), binary, pa.array(parities(value, bounds), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return docs.mapInArrow(sign, "id long, n long, a long, b long, signature binary, parity binary")

    def _crowded(self, reps: DataFrame) -> DataFrame:
        """(entry, id, hub): entries that several representatives share; hub is
        the least of them. Entries stream by in order, one batch at a time."""
        errors = self.errors

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    rows = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
                    listed = entries(rows, errors).view(np.int64)
                    ids = np.repeat(part.column("id").to_numpy(), listed.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(listed.ravel()), pa.array(ids)], ["entry", "id"])

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = hub = None  # the entry that may go on, and its least id
            single = False  # whether only the hub has been met, and isn't out yet
            for batch in batches:
                entry, ids = batch.column("entry").to_numpy(), batch.column("id").to_numpy()
                if not len(entry):
                    continue
                if last is not None:
                    entry, ids = np.concatenate(([last], entry)), np.concatenate(([hub], ids))
                starts = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
                sizes = np.diff(np.concatenate((starts, [len(entry)])))
                hubs = np.repeat(ids[starts], sizes)
                keep = np.repeat(sizes > 1, sizes)
                if last is not None and not single:
                    keep[: sizes[0]] = True
                    keep[0] = False  # this hub is out already
                single = bool(sizes[-1] == 1 and (len(sizes) > 1 or single or last is None))
                last, hub = entry[-1], hubs[-1]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (entry, ids, hubs)], ["entry", "id", "hub"])

        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        listed = reps.select("id", "signature").mapInArrow(enter, "entry long, id long")
        ordered = listed.repartition(partitions, "entry").sortWithinPartitions("entry", "id")
        return materialize(self.spark, ordered.mapInArrow(runs, "entry long, id long, hub long"), "entries", "lz4")

    def _near(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs (u, v) whose signatures are within reach and whose sets may be similar."""
        parts = self.parts

        def reach(left: pa.Array, right: pa.Array, n: pa.Array, m: pa.Array, odd: pa.Array, even: pa.Array) -> pa.Array:
            read = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            out = (read(left) != read(right)).sum(1) <= FAR
            x = np.flatnonzero(out)
            bound = Bound(np.concatenate((n.to_numpy(), m.to_numpy())), odd.to_pylist() + even.to_pylist(), parts)
            out[x] = bound.passes(x, x + len(out))
            return pa.array(out)

        one = reps.select(F.col("id").alias("u"), F.col("signature").alias("su"), F.col("n").alias("nu"), F.col("parity").alias("pu"))
        two = reps.select(F.col("id").alias("v"), F.col("signature").alias("sv"), F.col("n").alias("nv"), F.col("parity").alias("pv"))
        both = pairs.join(one, "u").join(two, "v")
        return both.where(F.arrow_udf(reach, "boolean")("su", "sv", "nu", "nv", "pu", "pv")).select("u", "v")

    def _sets(self, ids: DataFrame, docs: DataFrame) -> DataFrame:
        """(id, set) of the documents with these ids and a few others. Only they
        leave the workers that read the texts, by a filter of bounded size."""
        n = self.shingle
        sent = bitfilter.build(self.spark, ids.select(F.xxhash64("id").alias("hash")), "hash")
        schema = pa.schema([("id", pa.int64()), ("set", pa.binary())])

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = batch.filter(pa.array(bitfilter.passes(sent.value, batch.column("hash").to_numpy())))
                for part in shards(some, "body"):
                    value, bounds = shingle_sets(*text_buffers(part.column("body")), n)
                    made = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.binary())], schema=schema)

        read = docs.where(F.col("id").isNotNull()).withColumn("hash", F.xxhash64("id"))
        return read.mapInArrow(sets, "id long, set binary")

    def _confirmed(self, pairs: DataFrame, docs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose full sets are similar enough."""
        parts = self.parts
        members = self._sets(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), docs)

        def similar(left: pa.Array, right: pa.Array) -> pa.Array:
            out = []
            for x, y in zip(left, right):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                if not len(a) or 100 * len(a) < parts * len(b):
                    out.append(False)
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int((b[at] == a).sum())
                out.append(100 * common >= parts * (len(a) + len(b) - common))
            return pa.array(out, pa.bool_())

        one = members.select(F.col("id").alias("u"), F.col("set").alias("su"))
        two = members.select(F.col("id").alias("v"), F.col("set").alias("sv"))
        both = pairs.join(one, "u").join(two, "v")
        return both.where(F.arrow_udf(similar, "boolean")("su", "sv")).select("u", "v")

    def _across(self, crowded: DataFrame, reps: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
        """What entries hold across components, within reach: for each document
        u the nearest v (u, v), or else every component that a document of a
        smaller one should be held against (u, target)."""
        sizes = labels.groupBy("component").agg(F.count("*").alias("members"))
        of = labels.join(sizes, "component").select(F.col("node").alias("id"), "component", "members")
        placed = crowded.select("entry", "id").join(of, "id", "left")
        placed = placed.withColumns({"component": F.coalesce("component", "id"), "members": F.coalesce("members", F.lit(1))})
        mixed = placed.groupBy("entry").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        rows = placed.join(mixed.select("entry", blocks.alias("blocks")), "entry").join(reps, "id")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("entry", "id", "component", "members", "n", "signature", "parity", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("far", pa.int32())])

        parts = self.parts

        def compare(ids: np.ndarray, component: np.ndarray, members: np.ndarray, signature: np.ndarray, bound: Bound, own: np.ndarray, low: int, high: int) -> pa.RecordBatch:
            left = np.flatnonzero(own == low)
            right = left if low == high else np.flatnonzero(own == high)
            step = max(1, (32 << 20) // (SYMBOLS * max(1, len(right))))
            found, best, best_at = [np.zeros((0, 3), np.int64)], np.full(len(right), FAR + 1), np.zeros(len(right), np.int64)
            for at in range(0, len(left) if len(right) else 0, step):
                i = left[at : at + step]
                far = (signature[i][:, None, :] != signature[right][None]).sum(2)
                far[component[i][:, None] == component[right][None]] = FAR + 1
                x, y = np.nonzero(far <= FAR)
                fit = bound.passes(i[x], right[y])
                far[x[~fit], y[~fit]] = FAR + 1
                if nearest:
                    x = np.arange(len(i))
                    y = far.argmin(1)
                    least, least_at = far.min(0), i[far.argmin(0)]
                    best_at = np.where(least < best, least_at, best_at)
                    best = np.minimum(least, best)
                    keep = far[x, y] <= FAR
                    x, y = x[keep], y[keep]
                    found.append(np.stack((ids[i][x], ids[right][y], far[x, y]), 1))
                else:
                    x, y = i[x[fit]], right[y[fit]]
                    swap = (members[x] > members[y]) | ((members[x] == members[y]) & (component[x] > component[y]))
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    found.append(np.unique(np.stack((ids[x], component[y], np.zeros(len(x), np.int64)), 1), axis=0))
            if nearest and low != high:
                y = np.flatnonzero(best <= FAR)
                found.append(np.stack((ids[right][y], ids[best_at[y]], best[y]), 1))
            rows = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k].astype(np.int64 if k < 2 else np.int32)) for k in range(3)], schema=schema)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []
            for batch in batches:
                key = np.stack([batch.column(c).to_numpy() for c in ("entry", "low", "high")], 1)
                starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))) if len(key) else []
                for a, b in zip(starts, [*starts[1:], len(key)]):
                    part = batch.slice(a, b - a)
                    if held and tuple(key[a]) != held[0]:
                        yield close(held)
                        held = []
                    held = held or [tuple(key[a])]
                    held.append(part)
            if held:
                yield close(held)

        def close(held: list) -> pa.RecordBatch:
            (_, low, high), batches = held[0], held[1:]
            join = lambda c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in batches])
            every = lambda c: [x for p in batches for x in p.column(c).to_pylist()]
            signature = np.frombuffer(b"".join(every("signature")), np.uint8).reshape(-1, SYMBOLS)
            return compare(join("id"), join("component"), join("members"), signature, Bound(join("n"), every("parity"), parts), join("own"), low, high)

        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartition(partitions, "entry", "low", "high").sortWithinPartitions("entry", "low", "high", "id")
        found = ordered.mapInArrow(pairs, "u long, v long, far int")
        if nearest:
            return found.groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("v"))
        return found.select("u", F.col("v").alias("target")).distinct()

    def _held_against(self, targets: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
        """Links (u, v) of documents u with members v of their target components,
        by their full sets. Both sides meet in blocks of SIDE documents, inside a
        worker, so pairs never become rows; one link of a u and a block is enough."""
        parts = self.parts
        wanted = targets.select("target").distinct()
        grown = labels.select(F.col("component").alias("target"), F.col("node").alias("id")).join(wanted, "target", "left_semi")
        alone = wanted.join(grown.select("target").distinct(), "target", "left_anti").select("target", F.col("target").alias("id"))
        members = grown.unionByName(alone)
        blocks = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
        shape = targets.groupBy("target").agg(F.count("*").alias("u")).join(members.groupBy("target").agg(F.count("*").alias("v")), "target")
        shape = shape.select("target", blocks("u").alias("us"), blocks("v").alias("vs"))
        both = targets.select("target", F.col("u").alias("id"), F.lit(0).alias("side")).unionByName(members.select("target", "id", F.lit(1).alias("side")))
        both = both.join(self._sets(both.select("id").distinct(), docs), "id").join(shape, "target")
        first = F.col("side") == 0
        own = F.pmod(F.xxhash64("id"), F.when(first, F.col("us")).otherwise(F.col("vs"))).cast("int")
        both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("vs")).otherwise(F.col("us")) - 1)))
        rows = both.select("target", F.when(first, F.col("own")).otherwise(F.col("other")).alias("ub"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("vb"), "side", "id", "set")
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def check(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            side = np.concatenate([p.column("side").to_numpy() for p in held])
            ids = np.concatenate([p.column("id").to_numpy() for p in held])
            sets = [np.frombuffer(x, np.uint64) for p in held for x in p.column("set").to_pylist()]
            full = np.array([len(x) > 0 for x in sets])
            one, two = np.flatnonzero((side == 0) & full), np.flatnonzero((side == 1) & full)
            out = []
            if len(one) and len(two):
                values, code = np.unique(np.concatenate([sets[k] for k in (*one, *two)]), return_inverse=True)
                size = np.array([len(sets[k]) for k in (*one, *two)])
                ends = np.cumsum(size)
                split = ends[len(one) - 1]
                theirs, starts, n = code[split:], ends[len(one) :] - size[len(one) :] - split, size[len(one) :]
                flags = np.zeros(len(values), bool)
                for k, at in enumerate(one):
                    mine = code[ends[k] - size[k] : ends[k]]
                    flags[mine] = True
                    common = np.add.reduceat(flags[theirs], starts, dtype=np.int64)
                    flags[mine] = False
                    fit = np.flatnonzero(100 * common >= parts * (size[k] + n - common))
                    if len(fit):
                        out.append((ids[at], ids[two[fit[0]]]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []
            last = None
            for batch in batches:
                key = np.stack([batch.column(c).to_numpy() for c in ("target", "ub", "vb")], 1)
                starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))) if len(key) else []
                for a, b in zip(starts, [*starts[1:], len(key)]):
                    if held and tuple(key[a]) != last:
                        yield check(held)
                        held = []
                    last = tuple(key[a])
                    held.append(batch.slice(a, b - a))
            if held:
                yield check(held)

        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartition(partitions, "target", "ub", "vb").sortWithinPartitions("target", "ub", "vb")
        return ordered.mapInArrow(links, "u long, v long")

    def find(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
        spark = self.spark
        docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
        signed = materialize(spark, self._signed(docs), "signed")
        linked = signed.where("n > 0 and id is not null")
        classes = linked.groupBy("a", "b").agg(F.min("id").alias("rep"))
        classes = materialize(spark, classes, "classes")
        reps = linked.join(classes.select(F.col("rep").alias("id"), "a", "b"), ["id", "a", "b"]).dropDuplicates(["id", "a", "b"])
        reps = materialize(spark, reps.select("id", "n", "signature", "parity"), "representatives")

        crowded = self._crowded(reps)
        stars = self._near(crowded.where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct(), reps)
        stars = materialize(spark, stars.groupBy("u").agg(F.min("v").alias("v")), "stars")
        first = materialize(spark, self._confirmed(stars, docs), "links")
        labels = materialize(spark, components(spark, first), "labels")
        links = first
        for _ in range(ROUNDS):
            near = materialize(spark, self._across(crowded, reps, labels, nearest=True), "near")
            new = materialize(spark, self._confirmed(near, docs), "links")
            # Who has no candidate now won't have one later: components only grow.
            crowded = crowded.join(near.select(F.col("u").alias("id")), "id", "left_semi")
            links = links.unionByName(new)
            labels = materialize(spark, components(spark, links), "labels")
        across = materialize(spark, self._across(crowded, reps, labels, nearest=False), "across")
        last = materialize(spark, self._held_against(across, labels, docs), "links")
        found = components(spark, links.unionByName(last))

        leads = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("a", "b", F.coalesce("component", "rep").alias("lead"))
        # An id may have several sets: each row follows its own set.
        alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("lead"))
        every = linked.join(leads, ["a", "b"]).select("id", "n", "lead").unionByName(alone)
        return every.select(
            F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("lead").alias("component_id"), F.coalesce(F.col("id") == F.col("lead"), F.lit(True)).alias("kept")
        )

    def keep_one(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of ``docs`` that stay: one document of each group, and all
        that are linked with nothing. Rows that repeat a doc_id stay or go
        together. Columns keep their names and values, whatever they are."""
        name = "_gone"
        while name in docs.columns:
            name += "_"
        gone = self.find(docs, doc_id, text).where(~F.col("kept")).select(F.col(doc_id).alias(name)).distinct()
        return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")

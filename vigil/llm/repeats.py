"""Substring deduplication: words of passages that an earlier document holds.

Words are runs of characters other than ASCII white space, compared as they
are. A window is ``width`` consecutive words of a text. Each word covered by a
window whose words also start in a document with a smaller id is removed;
windows are judged on the input, not on what is left.

1. Passages. Each window is named by its least-hashed run of SEED words, and
   consecutive windows named by the same run form a passage of at most
   2 * width - SEED words. Equal windows have equal names.
2. Names that occur in one document only can't repeat. Their counts are summed
   by Spark; the others make a bounded membership filter.
3. Passages with a name that passes go to the shard of their name, equal ones
   within an Arrow batch once. Where a name has over CROWD passages, its windows
   travel one by one and are dealt by the whole window's hash instead, so near
   copies in any number spread over all tasks.
4. Each shard, whole names of bounded bytes, gets a compressed FM-index: a
   wavelet tree over the Burrows-Wheeler transform, a bit vector that marks
   where suffixes begin to differ within ``width`` words, and the least document
   of each such range. The passages stream through it from right to left: one
   backward step a word, and a return to the range of ``width`` words, so the
   matching statistic is known at every word up to the threshold.
5. A join on the passages' names brings the ranges' least documents back to
   whatever holds the passages, and windows with a smaller one are spans.

Null texts and texts of fewer words than ``width`` lose nothing; rows without an
id neither lose words nor cause others to; rows that share an id don't cause
each other's losses, and each row is judged by its own text; an empty table
gives an empty one. Other columns stay as they are; one named like the output
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bitfilter
from vigil.llm.fmindex import Bits, FMIndex, suffix_array
from vigil.llm.kernels import NOT_SPACE, mix, owner, shards, text_buffers, words
from vigil.session import materialize, ship_package

#: Words that name a window.
SEED = 4
#: Passages of one name beyond which its windows travel one by one.
CROWD = 4096
#: Bytes of passages in one FM-index (and the rest of its last name).
SHARD_BYTES = 1 << 20
#: Bytes of passages for each shuffle partition.
PARTITION_BYTES = 16 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def _runs(code: np.ndarray, count: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hash of the ``count`` words from each word on (as many as there are)."""
    out = np.zeros(len(code) - count + 1, np.uint64)
    for k in range(count):
        out = out * step + code[k : len(code) - count + 1 + k]
    return mix(out)


class Passages:
    """The passages of one shard of texts: name, first word and number of
    windows of each, by text and place."""

    def __init__(self, texts: pa.Array, width: int):
        raw, bounds = text_buffers(texts)
        self.raw = raw
        self.start, self.end, self.code, at = words(raw, bounds, NOT_SPACE, lower=False)
        self.width = width
        seed = min(SEED, width)
        n = len(self.code) - width + 1
        none = np.zeros(0, np.int64)
        self.first, self.count, self.text, self.name = none, none, none, np.zeros(0, np.uint64)
        self.at = at
        if n <= 0:
            return
        text = owner(at)
        inside = text[:n] == text[width - 1 :]
        name = _runs(self.code, seed)
        place = np.lib.stride_tricks.sliding_window_view(name, width - seed + 1).argmin(1) + np.arange(n)
        where = np.flatnonzero(inside)
        if not len(where):
            return
        place = place[where]
        new = np.ones(len(where), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(where) > 1) | (text[where[1:]] != text[where[:-1]])
        begin = np.flatnonzero(new)
        self.first, self.count = where[begin], np.diff(np.append(begin, len(where)))
        self.text, self.name = text[self.first], name[place[begin]]

    def kept(self, keep: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, first word, windows, text) of the passages to keep, those of
        crowded names as single windows."""
        alone = keep & crowded
        keep = keep & ~crowded
        key, first, count, text = self.name[keep], self.first[keep], self.count[keep], self.text[keep]
        if alone.any():
            sizes = self.count[alone]
            each = np.repeat(self.first[alone] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            key = np.concatenate((key, _runs(self.code, self.width)[each]))
            first = np.concatenate((first, each))
            count = np.concatenate((count, np.ones(len(each), np.int64)))
            text = np.concatenate((text, np.repeat(self.text[alone], sizes)))
        return key, first, count, text

    def hashes(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A hash of each passage, unlike the hashes that make keys."""
        out = count.astype(np.uint64)
        longest = int(count.max(initial=0)) + self.width - 1
        last = first + count + self.width - 1
        for k in range(longest):
            at = first + k
            inside = at < last
            out = np.where(inside, out * _TURN + self.code[np.where(inside, at, 0)], out)
        return mix(out)


class ShardIndex:
    """Least documents of all windows of a shard's passages."""

    def __init__(self, passages: pa.Array, least: np.ndarray, width: int):
        raw, bounds = text_buffers(passages)
        _, _, code, at = words(raw, bounds, NOT_SPACE, lower=False)
        _, symbol = np.unique(code, return_inverse=True)
        own = owner(at)
        place = np.arange(len(code)) + own  # a separator ends each passage
        self.symbols = np.zeros(len(code) + len(passages), np.int64)
        self.symbols[place] = symbol + 1
        self.at, self.width = at, width
        order = suffix_array(self.symbols)
        self.index = FMIndex(self.symbols, order=order)
        # Suffixes that agree on ``width`` words stand side by side; none of these words is a separator.
        padded = np.concatenate((self.symbols, np.zeros(width, np.int64)))
        differs = np.zeros(len(order), bool)
        differs[0] = True
        for k in range(width):
            column = padded[order + k]
            differs[1:] |= (column[1:] != column[:-1]) | (column[1:] == 0)
        self.edges = Bits(differs)
        begin = np.flatnonzero(differs)
        self.begin, self.stop = begin, np.append(begin[1:], len(order))
        documents = np.repeat(least, np.diff(at) + 1)
        self.least = np.minimum.reduceat(documents[order], begin)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(passage, least document) of every window, each passage's windows
        from left to right."""
        index, width = self.index, self.width
        sizes = np.diff(self.at)
        last = self.at[1:] + np.arange(len(sizes)) - 1  # place of each passage's last word
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.length, np.int64)
        out = np.zeros(int((sizes - width + 1).sum()), np.int64)
        bound = np.cumsum(sizes - width + 1)
        alive = np.arange(len(sizes))
        for back in range(int(sizes.max(initial=0))):
            alive = alive[sizes[alive] > back]
            symbol = self.symbols[last[alive] - back]
            ends = index._rank(np.concatenate((symbol, symbol)), np.concatenate((low[alive], high[alive])))
            low[alive] = index.first[symbol] + ends[: len(alive)]
            high[alive] = index.first[symbol] + ends[len(alive) :]
            if back >= width - 1:
                # A match of ``width`` words or one more: back to the range of the first ``width``.
                which = self.edges.rank(low[alive] + 1) - 1
                low[alive], high[alive] = self.begin[which], self.stop[which]
                out[bound[alive] - 1 - (back - width + 1)] = self.least[which]
        return np.repeat(np.arange(len(sizes)), sizes - width + 1), out


class SubstringDedup:
    """The operator: the spans of repeated passages, or texts without them."""

    def __init__(self, spark: SparkSession, width: int = 13, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, partition_bytes: int = PARTITION_BYTES):
        ship_package(spark)
        self.spark, self.width, self.crowd = spark, width, crowd
        self.shard_bytes, self.partition_bytes = shard_bytes, partition_bytes

    def _names(self, docs: DataFrame) -> DataFrame:
        """(name, least and greatest document, passages, bytes) of names that
        occur in more than one document."""
        width = self.width

        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in shards(batch):
                    found = Passages(part.column("text"), width)
                    ids = np.asarray(part.column("doc"))[found.text]
                    yield pa.record_batch([pa.array(found.name.view(np.int64)), pa.array(ids)], ["name", "doc"])

        each = docs.select("doc", "text").mapInArrow(names, "name long, doc long")
        summed = each.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("passages"))
        return summed.where("least < most").select("name", "passages")

    def _passages(self, docs: DataFrame, shared, crowded) -> DataFrame:
        """key, hash, passage, its least document here, and what holds it (row,
        doc, first word), a row for each passage and slice of a batch."""
        width = self.width
        kind = pa.list_(pa.struct([("row", pa.int64()), ("doc", pa.int64()), ("word", pa.int64())]))

        def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in shards(batch):
                    found = Passages(part.column("text"), width)
                    name = found.name.view(np.int64)
                    key, first, count, text = found.kept(bitfilter.passes(shared.value, name), bitfilter.passes(crowded.value, name))
                    if not len(key):
                        continue
                    code = found.hashes(first, count)
                    ids, row = np.asarray(part.column("doc")), np.asarray(part.column("row"))
                    way = np.lexsort((ids[text], code, key))
                    key, code, first, count, text = key[way], code[way], first[way], count[way], text[way]
                    head = np.ones(len(key), bool)
                    head[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
                    at = np.flatnonzero(head)
                    begin, end = found.start[first[at]], found.end[first[at] + count[at] + width - 2]
                    sizes = end - begin
                    offsets = np.concatenate(([0], np.cumsum(sizes)))
                    inside = np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])
                    string = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(found.raw[inside].tobytes())])
                    holder = pa.StructArray.from_arrays([pa.array(row[text]), pa.array(ids[text]), pa.array(first - found.at[text])], ["row", "doc", "word"])
                    held = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), holder)
                    yield pa.record_batch(
                        [pa.array(key[at].view(np.int64)), pa.array(code[at].view(np.int64)), string.cast(pa.string()), pa.array(ids[text[at]]), held.cast(kind)],
                        ["key", "hash", "passage", "least", "held"],
                    )

        return docs.mapInArrow(passages, "key long, hash long, passage string, least long, held array<struct<row:long,doc:long,word:long>>")

    def _ranges(self, passages: DataFrame, partitions: int) -> DataFrame:
        """(key, hash, least documents of the passage's windows) of every
        distinct passage, from the FM-indexes of its shard."""
        width, limit = self.width, self.shard_bytes

        def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            key, code = np.asarray(table["key"]), np.asarray(table["hash"])
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
            at = np.flatnonzero(head)
            least = np.minimum.reduceat(np.asarray(table["least"]), at)
            strings = table["passage"].take(pa.array(at)).combine_chunks()
            strings = strings if isinstance(strings, pa.Array) else strings.chunk(0)
            which, found = ShardIndex(strings, least, width).statistics()
            ends = np.searchsorted(which, np.arange(len(at) + 1)).astype(np.int32)
            return pa.record_batch([pa.array(key[at]), pa.array(code[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], ["key", "hash", "least"])

        def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.asarray(batch.column("key"))
                _, bounds = text_buffers(batch.column("passage"))
                edges = np.flatnonzero(key[1:] != key[:-1]) + 1
                if held and key[0] != held[-1].column("key")[-1].as_py():
                    edges = np.concatenate(([0], edges))
                begin = 0
                for edge in edges.tolist():
                    if size + bounds[edge] - bounds[begin] >= limit:
                        if edge > begin:
                            held.append(batch.slice(begin, edge - begin))
                        yield search(held)
                        held, size, begin = [], 0, edge
                held.append(batch.slice(begin))
                size += int(bounds[-1] - bounds[begin])
            if held:
                yield search(held)

        dealt = passages.select("key", "hash", "passage", "least").repartition(partitions, "key").sortWithinPartitions("key", "hash")
        return dealt.mapInArrow(shard, "key long, hash long, least array<long>")

    def spans(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """(row, doc, starts) of the texts with repeated windows: ``row`` is the
        hash of id and text, ``starts`` the words where such windows begin."""
        rows = docs.select(F.col(doc_id).cast("long").alias("doc"), _row(doc_id, text).alias("row"), F.col(text).cast("string").alias("text"))
        rows = rows.where("doc IS NOT NULL AND text IS NOT NULL")
        names = materialize(self.spark, self._names(rows), "repeat-names")
        total = names.agg(F.sum("passages")).first()[0] or 0
        shared = bitfilter.build(self.spark, names, "name")
        crowded = bitfilter.build(self.spark, names.where(F.col("passages") > self.crowd), "name")
        passages = self._passages(rows, shared, crowded)
        partitions = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), total * 120 // self.partition_bytes)
        ranges = materialize(self.spark, self._ranges(passages, partitions), "repeat-ranges")
        each = passages.select("key", "hash", "held").join(ranges, ["key", "hash"]).select(F.inline("held"), "least")
        starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc"), F.col("word") + i)), lambda x: x.isNotNull())
        hit = each.where(F.array_min("least") < F.col("doc")).select("row", "doc", starts.alias("starts"))
        return hit.groupBy("row", "doc").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def remove(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "repeats") -> DataFrame:
        """``docs`` with a column ``out``: n_words, n_removed, and kept, the
        words that stay, joined by one space."""
        width = self.width
        kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

        def cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
            rows = []
            for value, start in zip(texts, starts):
                found = (value.as_py() or "").encode().split()
                if start.is_valid:
                    change = np.zeros(len(found) + 1, np.int64)
                    begin = np.asarray(start.values)
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + width, -1)
                    left = list(compress(found, (np.cumsum(change[:-1]) == 0).tolist()))
                else:
                    left = found
                rows.append((len(found), len(found) - len(left), b" ".join(left).decode()))
            n, removed, kept = zip(*rows) if rows else ((), (), ())
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], fields=list(kind))

        names = _free(docs, 3)
        spans = self.spans(docs, text, doc_id).toDF(*names)
        joined = docs.withColumns({names[0]: _row(doc_id, text), names[1]: F.col(doc_id).cast("long")}).join(spans, names[:2], "left")
        done = joined.withColumn(out, F.arrow_udf(cut, "n_words long, n_removed long, kept string")(F.col(text).cast("string"), F.col(names[2])))
        return done.select(*[c for c in docs.columns if c != out], out)


def _row(doc_id: str, text: str):
    """A hash of a row's id and text; null, which joins nothing, without either."""
    both = F.col(doc_id).isNotNull() & F.col(text).isNotNull()
    return F.when(both, F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")))


def _free(docs: DataFrame, count: int) -> list[str]:
    """Column names that ``docs`` doesn't use."""
    taken, out = {c.lower() for c in docs.columns}, []
    while len(out) < count:
        name = f"_r{len(taken) + len(out)}"
        while name in taken or name in out:
            name += "_"
        out.append(name)
    return out

"""Benchmark decontamination with an FM-index per shard of training text.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond
ASCII. Each window of ``width`` consecutive words of a benchmark item is a
phrase; an item of fewer words, but not none, is one phrase. A worker cuts its
documents into shards of bounded size, maps words to the phrases' vocabulary
(everything between such words collapses to a separator), builds an FM-index
over the shard, searches all phrases backwards through wavelet-tree ranks,
locates occurrences by sampled suffix positions, and merges them to spans.

Documents are never shuffled, and their words are cut once for each group of
blocks. The benchmark reaches the executors in blocks of bounded size, each with a
vocabulary and hence an FM-index of its own; tasks hold the blocks of GROUP_BYTES
at a time, and with a larger benchmark a table between groups keeps what was
found so far, so memory doesn't grow with it.

Null texts have no words; null texts or texts without words of benchmark items
are no phrases; items without an item_id cause hits but are not listed; items
with equal ids count once; repeated documents are handled one by one; an empty
benchmark hits nothing. A text longer than a shard is a shard of its own. A
column named like ``out`` is replaced, other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.kernels import ALNUM, shards, text_buffers, words
from vigil.session import materialize, ship_package

#: Bytes of benchmark text in one broadcast block (a longer item is a block of its own).
BLOCK_BYTES = 8 << 20
#: Bytes of benchmark text in the blocks that are broadcast together.
GROUP_BYTES = 64 << 20

KIND = "struct<n_words:bigint,hits:array<struct<word:int,word_end:int,byte:bigint,byte_end:bigint>>,items:array<string>>"
ARROW_KIND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("word", pa.int32()), ("word_end", pa.int32()), ("byte", pa.int64()), ("byte_end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


class Phrases:
    """The distinct phrases of some items, over their vocabulary."""

    def __init__(self, rows: list[tuple[str | None, str]], width: int):
        raw, bounds = text_buffers(pa.array([x[1] for x in rows], pa.large_string()))
        _, _, code, at = words(raw, bounds, ALNUM)
        self.vocabulary, symbol = np.unique(code, return_inverse=True)
        symbol = symbol.astype(np.int32) + 1
        windows, lengths, owners = [], [], []
        for i in range(len(rows)):
            own = symbol[at[i] : at[i + 1]]
            if not len(own):
                continue
            if len(own) < width:
                own = np.concatenate((np.zeros(width - len(own), np.int32), own))
                lengths.append([int(at[i + 1] - at[i])])
            else:
                lengths.append([width] * (len(own) - width + 1))
            windows.append(np.lib.stride_tricks.sliding_window_view(own, width))
            owners += [i] * len(windows[-1])
        if not windows:
            self.pattern = np.zeros((0, width), np.int32)
            self.length = np.zeros(0, np.int64)
        else:
            self.pattern, which = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
            which = which.ravel()
            self.length = np.zeros(len(self.pattern), np.int64)
            self.length[which] = np.concatenate(lengths)
            order = np.argsort(which, kind="stable")
            self.owner = np.asarray(owners)[order]
            self.owner_at = np.searchsorted(which[order], np.arange(len(self.pattern) + 1))
        self.names = [x[0] for x in rows]


def blocks(items: DataFrame, item_id: str, text: str, width: int, limit: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """Phrases of the benchmark, streamed to the driver in bounded blocks."""
    held, size = [], 0
    rows = items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    for name, content in rows.toLocalIterator():
        held.append((name, content))
        size += len(content.encode())
        if size >= limit:
            yield Phrases(held, width)
            held, size = [], 0
    if held:
        yield Phrases(held, width)


def search_shard(code: np.ndarray, at: np.ndarray, phrases: Phrases):
    """(covered flag per word, pairs of text and item with a hit) for the words
    of one shard: their hashes and the texts' bounds."""
    from vigil.llm.fmindex import FMIndex

    covered = np.zeros(len(code), bool)
    none = np.zeros((0, 2), np.int64)
    if not len(code) or not len(phrases.pattern):
        return covered, none
    near = np.searchsorted(phrases.vocabulary, code)
    near[near == len(phrases.vocabulary)] = 0
    kept = np.flatnonzero(phrases.vocabulary[near] == code)
    if not len(kept):
        return covered, none
    # A separator stands before each word whose neighbour isn't kept or is in another text.
    first = np.zeros(len(code) + 1, bool)
    first[at] = True
    apart = first[kept]
    apart[0] = True
    apart[1:] |= np.diff(kept) > 1
    place = np.arange(len(kept)) + np.cumsum(apart)
    symbols = np.zeros(int(place[-1]) + 2, np.int64)
    symbols[place] = near[kept] + 1
    index = FMIndex(symbols)
    low, high = index.search(phrases.pattern, phrases.length)
    found = np.flatnonzero(high > low)
    if not len(found):
        return covered, none
    counts = (high - low)[found]
    pattern = np.repeat(found, counts)
    rows = np.repeat(low[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    word_at = np.zeros(len(symbols), np.int64)
    word_at[place] = kept
    word = word_at[index.locate(rows)]
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + phrases.length[pattern], -1)
    covered = np.cumsum(change[:-1]) > 0
    text = np.searchsorted(at, word, "right") - 1
    hit = np.unique(np.stack((text, pattern), 1), axis=0)
    sizes = phrases.owner_at[hit[:, 1] + 1] - phrases.owner_at[hit[:, 1]]
    offsets = np.repeat(phrases.owner_at[hit[:, 1]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    pairs = np.unique(np.stack((np.repeat(hit[:, 0], sizes), phrases.owner[offsets]), 1), axis=0)
    return covered, pairs


def _annotated(texts: pa.Array, blocks: list[Phrases], before: pa.Array | None = None) -> Iterator[dict]:
    """KIND of each text, shard by shard, with what was found ``before``."""
    columns = {"text": texts} | ({} if before is None else {"before": before})
    for part in shards(pa.record_batch(list(columns.values()), list(columns))):
        raw, bounds = text_buffers(part.column(0))
        start, end, code, at = words(raw, bounds, ALNUM)
        out = [{"n_words": int(n), "hits": [], "items": []} for n in np.diff(at)]
        covered = np.zeros(len(code), bool)
        if before is not None:
            for t, old in enumerate(part.column(1).to_pylist()):
                out[t]["items"] += old["items"]
                for s in old["hits"]:
                    covered[at[t] + s["word"] : at[t] + s["word_end"]] = True
        for phrases in blocks:
            some, pairs = search_shard(code, at, phrases)
            covered |= some
            for t, item in pairs.tolist():
                if phrases.names[item] is not None:
                    out[t]["items"].append(phrases.names[item])
        if covered.any():
            flags = np.concatenate(([False], covered, [False]))
            inner = np.zeros(len(covered) + 1, bool)
            inner[at] = True  # a span ends with its text
            opens = np.flatnonzero(flags[1:-1] & (~flags[:-2] | inner[:-1]))
            closes = np.flatnonzero(flags[1:-1] & (~flags[2:] | inner[1:])) + 1
            for a, b, t in zip(opens.tolist(), closes.tolist(), (np.searchsorted(at, opens, "right") - 1).tolist()):
                out[t]["hits"].append({"word": a - int(at[t]), "word_end": b - int(at[t]), "byte": int(start[a] - bounds[t]), "byte_end": int(end[b - 1] - bounds[t])})
        for row in out:
            row["items"] = sorted(set(row["items"]))
            yield row


def annotate(texts: pa.Array, *blocks: Phrases) -> pa.Array:
    """KIND of each text."""
    return pa.array(list(_annotated(texts, list(blocks))), ARROW_KIND)


def _groups(spark: SparkSession, items: DataFrame, width: int, item_id: str, item_text: str) -> Iterator[list]:
    """Broadcasts of the benchmark's blocks, those of one group together; one
    group at least."""
    ship_package(spark)
    held: list = []
    some = False
    for found in blocks(items, item_id, item_text, width, BLOCK_BYTES):
        held.append(spark.sparkContext.broadcast(found))
        some = True
        if len(held) * BLOCK_BYTES >= GROUP_BYTES:
            yield held
            held = []
    if held or not some:
        yield held


def find_passages(
    spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks"
) -> DataFrame:
    """``docs`` with a column ``out`` of KIND: its words, the merged spans of
    hit words (also in UTF-8 bytes, ends exclusive), and the items' ids, sorted."""
    groups = _groups(spark, items, width, item_id, item_text)
    return _found(spark, docs, next(groups), groups, text, out)


def _found(spark: SparkSession, docs: DataFrame, first: list, groups: Iterator[list], text: str, out: str) -> DataFrame:
    body = F.col(text).cast("string")
    found = docs.withColumn(out, _first_hits(first)(body))
    for sent in groups:
        found = materialize(spark, found, "passages")
        found = found.withColumn(out, _more_hits(sent)(body, F.col(out)))
    return found


def _first_hits(sent: list):
    return F.arrow_udf(lambda t: annotate(t, *[x.value for x in sent]), KIND)


def _more_hits(sent: list):
    def more(texts: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array(list(_annotated(texts, [x.value for x in sent], before)), ARROW_KIND)

    return F.arrow_udf(more, KIND)


def _cut(text: str, hits: list[dict]) -> str:
    raw, kept, at = text.encode(), [], 0
    for s in hits:
        kept += [raw[at : s["byte"]], b"\n"]
        at = s["byte_end"]
    return b"".join([*kept, raw[at:]]).decode()


def remove_passages(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the words of benchmark passages: each merged span gives
    way to a line break. Texts without hits stay as they are."""
    groups = _groups(spark, items, width, item_id, item_text)
    first, second = next(groups), next(groups, None)
    cut = lambda texts, rows: pa.array([_cut(t.as_py(), hits) if hits else t.as_py() for t, hits in zip(texts, rows)], pa.string())
    if second is None:  # one pass finds and cuts
        clean = F.arrow_udf(lambda t: cut(t, (row["hits"] for row in _annotated(t, [x.value for x in first]))), "string")
        return docs.withColumn(text, clean(F.col(text).cast("string"))).select(*docs.columns)
    name = "_hits"
    while name in docs.columns:
        name += "_"
    found = _found(spark, docs, first, chain([second], groups), text, name)
    clean = F.arrow_udf(lambda t, h: cut(t, h.to_pylist()), "string")
    return found.withColumn(text, clean(F.col(text).cast("string"), F.col(f"{name}.hits"))).select(*docs.columns)

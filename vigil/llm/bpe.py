"""Byte-level BPE encoding and decoding.

Merges run over a hierarchical-bitmap rank queue: one bucket per merge rank
holds linked-list positions, two levels of bitmap words mark the buckets in use,
find-first-set over them picks the next rank, and entries whose pair has changed
since are skipped when they come up. The new distinct pre-tokens of a slice of
texts share one queue, so that a bucket is one step of array work; a long
pre-token has a queue of its own and takes O(n log n) steps for n bytes. Ranks
come from a vocabulary file that is never trained here.

Null texts count as empty (no ids); empty texts give no ids; other columns
stay as they are; equal rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.pretokens import Remembered, give_back, splitter
from vigil.session import ship_package

#: A vocabulary is broadcast, so its file may not be larger than this.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bits of one bitmap word; ranks up to 2**16 then take two levels of 2**8 bits,
#: and the upper word has a bit more for every further 256 ranks.
_SHIFT, _MASK = 8, 255
_BIT = [1 << i for i in range(256)]
#: Bytes of texts whose pre-tokens share a rank queue, and the fewest new pre-tokens that do.
SLICE_BYTES, QUEUED = 2 << 20, 64


class BytePairs:
    """Encoder and decoder over {token bytes: rank}; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The lower bitmap words, all zero between calls.
        self.low = [0] * ((max(ranks.values()) >> _SHIFT) + 1)
        self.split = splitter(pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of, longest = len(piece), self.ranks.get, self.longest
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        low, buckets, top = self.low, {}, 0
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                rank[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so still a heap
                else:
                    buckets[r] = [i]
                    low[r >> _SHIFT] |= _BIT[r & _MASK]
                    top |= 1 << (r >> _SHIFT)
        while top:
            # Find-first-set in the upper word, then in the lower word.
            high = (top & -top).bit_length() - 1
            word = low[high]
            r = (high << _SHIFT) + (word & -word).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                word &= word - 1
                low[high] = word
                if not word:
                    top &= top - 1
            if rank[i] != r:
                continue  # stale: this pair was merged or changed since
            gone = after[i]
            end = after[i] = after[gone]
            rank[gone] = rank[i] = -1
            left = before[i]
            if end < n:
                before[end] = i
                stop = after[end]
                new = rank_of(piece[i:stop]) if stop - i <= longest else None
                if new is not None:
                    rank[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        low[new >> _SHIFT] |= _BIT[new & _MASK]
                        top |= 1 << (new >> _SHIFT)
            if left >= 0:
                new = rank_of(piece[left:end]) if end - left <= longest else None
                if new is None:
                    rank[left] = -1
                elif new != rank[left]:
                    rank[left] = new
                    if new in buckets:
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        low[new >> _SHIFT] |= _BIT[new & _MASK]
                        top |= 1 << (new >> _SHIFT)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    @cached_property
    def pairs(self) -> tuple[np.ndarray, ...] | None:
        """(id of each byte, rank of each pair of bytes, sorted keys of all pairs
        of tokens that make a token, their ranks, whether a token is part of one
        of a lower rank); None if some byte is no token."""
        rank_of, count = self.ranks.get, max(self.ranks.values()) + 1
        single = np.array([rank_of(bytes([b]), -1) for b in range(256)], np.int64)
        if (single < 0).any():
            return None
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = rank_of(token[:cut]), rank_of(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * count + right)
                    values.append(rank)
        keys, values = np.array(keys or [-1], np.int64), np.array(values or [-1], np.int32)
        order = np.argsort(keys)
        two = np.full((256, 256), -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                two[token[0], token[1]] = rank
        early = np.zeros(count, bool)
        for part in (keys // count, keys % count):
            early[part[values < part]] = True
        return single, two, keys[order], values[order], early

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of many pre-tokens, none of them empty, by one rank queue
        over all of them. A bucket's entries, sorted and with stale ones left out,
        are merged at once: of pairs that overlap every other one from the left.
        Where a merge could make a pair of a lower rank, which would come next,
        only the first entry of each pre-token is merged and the others go back,
        so the order is that of ``merge``."""
        single, two, keys, values, lower = self.pairs
        count = len(self.low) << _SHIFT
        factor = max(self.ranks.values()) + 1
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        # Place n stands for none.
        token = np.append(single[raw], 0).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[start + size - 1] = n
        before[start] = n
        rank = np.full(n + 1, -1, np.int32)
        rank[: n - 1] = two[raw[:-1], raw[1:]]
        rank[start + size - 1] = -1
        buckets: dict[int, list[np.ndarray]] = {}
        low, top = [0] * (count >> _SHIFT), 0

        def push(place: np.ndarray, ranks: np.ndarray) -> int:
            if len(place) > 1:
                order = np.argsort(ranks, kind="stable")
                place, ranks = place[order], ranks[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            else:
                cuts = [0, len(ranks)]
            upper = 0
            for a, b, r in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist() if len(ranks) else ()):
                if r in buckets:
                    buckets[r].append(place[a:b])
                else:
                    buckets[r] = [place[a:b]]
                    low[r >> _SHIFT] |= _BIT[r & _MASK]
                    upper |= 1 << (r >> _SHIFT)
            return upper

        first = np.flatnonzero(rank >= 0)
        top |= push(first, rank[first])
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            r = (high << _SHIFT) + (word & -word).bit_length() - 1
            low[high] = word & (word - 1)
            if not low[high]:
                top &= top - 1
            held = buckets.pop(r)
            place = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            place = place[rank[place] == r]  # others are stale
            if len(place) > 1 and lower[r]:
                first = np.append(True, owner[place[1:]] != owner[place[:-1]])
                if not first.all():
                    buckets[r] = [place[~first]]
                    low[high] |= _BIT[r & _MASK]
                    top |= 1 << high
                    place = place[first]
            elif len(place) > 1:
                linked = place[1:] == after[place[:-1]]
                if linked.any():
                    fresh = np.append(True, ~linked)
                    number = np.arange(len(place))
                    place = place[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
            if not len(place):
                continue
            gone = after[place]
            end = after[gone]
            after[place] = end
            before[end] = place
            rank[gone] = -1
            token[place] = r
            left = before[place]
            own = np.concatenate((left, place))
            key = token[own].astype(np.int64) * factor + token[np.concatenate((place, end))]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            fresh = np.where(keys[at] == key, values[at], -1)
            fresh[own == n] = -1
            fresh[len(left) :][end == n] = -1
            rank[own] = fresh
            rank[n] = -1
            real = fresh >= 0
            own, fresh = own[real], fresh[real]
            top |= push(own, fresh)
        alive = np.zeros(n + 1, bool)
        alive[start] = True
        at = start
        while len(at):
            at = after[at]
            at = at[at < n]
            alive[at] = True
        kept = np.flatnonzero(alive)
        ids, bounds = token[kept], np.searchsorted(kept, np.append(start, n))
        return ids, bounds

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Worker:
    """What one Python worker keeps for a vocabulary, across its tasks."""

    kept: dict[tuple[str, str], _Worker] = {}

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.pairs = BytePairs(ranks, pattern)
        merge = self.pairs.merge
        self.packed = Remembered(lambda p: np.array(merge(p.encode("utf-8", "surrogatepass")), np.int32).tobytes())
        self.decimal = Remembered(lambda p: ",".join(map(str, merge(p.encode("utf-8", "surrogatepass")))))
        decode = self.pairs.decode
        self.decoded = Remembered(lambda ids: decode(map(int, ids.split(","))))

    def forget(self) -> None:
        """Give the memory of results back at the end of a task, as a worker that
        waits for other work keeps what it holds."""
        for known in (self.packed, self.decimal, self.decoded):
            known.clear()
            known.used = 0
        give_back()

    @classmethod
    def get(cls, vocabulary: bytes, pattern: str) -> _Worker:
        key = (hashlib.md5(vocabulary).hexdigest(), pattern)
        if key not in cls.kept:
            cls.kept[key] = cls(vocabulary, pattern)
        return cls.kept[key]

    def _learn(self, known: Remembered, pieces, form: Callable[[list[int]], object]) -> None:
        """Put the results of new pre-tokens into ``known``, by one rank queue."""
        known.make_room()
        fresh = [p for p in pieces if p not in known and len(p) <= known.LONGEST]
        if len(fresh) < QUEUED or self.pairs.pairs is None:
            return  # each is merged by itself when it is met
        data = [p.encode("utf-8", "surrogatepass") for p in fresh]
        whole = list(map(self.pairs.ranks.get, data))
        ids, bounds = self.pairs.merge_all([d for d, w in zip(data, whole) if w is None])
        ids, bounds, k = ids.tolist(), bounds.tolist(), 0
        for piece, one in zip(fresh, whole):
            if one is None:
                known.put(piece, form(ids[bounds[k] : bounds[k + 1]]))
                k += 1
            else:
                known.put(piece, form([one]))

    def split(self, column: pa.Array, known: Remembered, form) -> Iterator[list[str]]:
        """The pre-tokens of each text, after those of a slice of texts, in
        which equal ones are one object, have been learnt."""
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0))
        ends = np.cumsum(sizes)
        start = 0
        while start < len(column):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + SLICE_BYTES, "right")))
            one: dict[str, str] = {}
            texts = [[one.setdefault(p, p) for p in self.pairs.split(t or "")] for t in column.slice(start, end - start).to_pylist()]
            self._learn(known, one, form)
            yield from texts
            start = end

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text as 32-bit integers; they are never Python objects."""
        for pieces in self.split(column, self.packed, lambda ids: np.array(ids, np.int32).tobytes()):
            yield b"".join(map(self.packed.__getitem__, pieces))

    def round_trip(self, pieces: list[str]) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the decimal ids, SHA-256 of the bytes
        that these ids decode to). Each distinct pre-token's ids are worked
        out once and decoded once; what is decoded are the ids as sent."""
        groups = list(map(self.decimal.__getitem__, pieces))
        sent = ",".join(groups)
        decoded = b"".join(map(self.decoded.__getitem__, groups))
        count = sent.count(",") + 1 if sent else 0
        return count, hashlib.sha256(sent.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


class ByteBPE:
    """The operator: columns of texts to columns of ids and back."""

    def __init__(self, spark: SparkSession, vocabulary_path: str, pattern: str):
        """vocabulary_path: a file of "base64(token) rank" lines on the driver."""
        ship_package(spark)
        with open(vocabulary_path, "rb") as file:
            data = file.read(MAX_VOCABULARY_BYTES + 1)
        if len(data) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{vocabulary_path} is too large to broadcast")
        self.vocabulary, self.pattern = spark.sparkContext.broadcast(data), pattern

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """Put the ids (array<int>) in column ``out``, replacing one of that name."""
        vocabulary, pattern = self.vocabulary, self.pattern

        def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            give_back()  # of what other work has left in this process
            worker = _Worker.get(vocabulary.value, pattern)
            for column in columns:
                ids, ends = bytearray(), [0]
                for own in worker.encode(column):
                    ids += own
                    ends.append(len(ids) // 4)
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)]))
            worker.forget()

        return df.withColumn(out, F.arrow_udf(encode, "array<int>")(F.col(text).cast("string")))

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """Put the bytes that ``ids`` stand for in column ``out`` (null: empty)."""
        vocabulary, pattern = self.vocabulary, self.pattern

        def decode(column: pa.Array) -> pa.Array:
            worker = _Worker.get(vocabulary.value, pattern)
            return pa.array([worker.pairs.decode(x or ()) for x in column.to_pylist()], pa.binary())

        return df.withColumn(out, F.arrow_udf(decode, "binary")(F.col(ids)))

    def round_trip(self, df: DataFrame, text: str = "text", out: str = "coded") -> DataFrame:
        """Encode and decode, keeping only a struct (n_tokens, ids_sha256,
        decoded_sha256), so that the ids need not leave the worker."""
        vocabulary, pattern = self.vocabulary, self.pattern
        kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

        def digests(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            give_back()  # of what other work has left in this process
            worker = _Worker.get(vocabulary.value, pattern)
            for column in columns:
                rows = [worker.round_trip(pieces) for pieces in worker.split(column, worker.decimal, lambda ids: ",".join(map(str, ids)))]
                yield pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), r)) for r in rows], kind)
            worker.forget()

        return df.withColumn(out, F.arrow_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(text).cast("string")))

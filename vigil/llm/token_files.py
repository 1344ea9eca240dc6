"""Token ids as binary files with Elias-Fano document boundaries.

A file image holds the ids of consecutive documents end to end, little-endian,
in 16 bits where the vocabulary allows it and 32 otherwise. Where each
document starts is an Elias-Fano sequence: the low bits of the offsets packed,
the high bits in unary. ``select`` over the unary part gives any offset by one
look-up in a sparse directory and a short scan, in about 2 + log2(ids /
documents) bits a document, instead of a 64-bit table. Document ids, which
ascend as well, are kept the same way, relative to the least. Readers ask for
boundaries by ``select``, AT_ONCE documents at a time, and never unpack all.

Spark has no writer for plain binary files, and a task's own file calls reach
no remote store, so an image is a cell of a Parquet table; ``Image`` reads its
bytes in place wherever they are put.

Layout, all little-endian: magic, version, bytes per id (u16 each), documents
(u64), ids (u64), least document id (i64), documents without id (u64, these
come first), the two sequences, the ids. A sequence is: count, universe (u64
each), low bits (u8), the low words, the high words (u64 each).
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.pretokens import Remembered, splitter
from vigil.session import new_path, ship_package

MAGIC, VERSION = b"VGEF", 1
HEADER = struct.Struct("<4sHHQQqQ")
SEQUENCE = struct.Struct("<QQB")
#: Bytes of ids after which a file image is closed (a longer document has its own).
IMAGE_BYTES = 4 << 20
MAX_TOKENIZER_BYTES = 64 << 20
#: Bytes of pre-tokens and their ids that a worker remembers.
REMEMBERED = 192 << 20
#: Documents whose boundaries a reader looks up at once.
AT_ONCE = 4096
#: Files whose bases are broadcast to the readers; beyond that they are joined by a shuffle.
MAX_BROADCAST_FILES = 200_000
#: The split that the byte-level pre-tokenizer of the tokenizers library makes.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class EliasFano:
    """A non-decreasing sequence of non-negative integers with ``select``."""

    STRIDE = 64  # the directory has the place of every 64th element

    def __init__(self, count: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.universe, self.low_bits, self.low, self.high = count, universe, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.directory = np.searchsorted(self.before + ones, np.arange(0, count, self.STRIDE), "right")

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        count = len(values)
        universe = int(values[-1]) + 1 if count else 0
        low_bits = max(0, (universe // max(count, 1)).bit_length() - 1)
        shift = np.uint64(low_bits)
        place = (values >> shift).astype(np.int64) + np.arange(count)
        high = np.zeros((int(place[-1]) // 64 + 1) * 64 if count else 0, np.uint8)
        high[place] = 1
        low = np.zeros(-(-count * low_bits // 64) * 64, np.uint8)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low[: count * low_bits] = bits.ravel().astype(np.uint8)
        pack = lambda x: np.packbits(x, bitorder="little").view(np.uint64)
        return cls(count, universe, low_bits, pack(low), pack(high))

    def select(self, i: int) -> int:
        """Element i: the place of the i-th set bit gives its high part."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at = int(self.directory[i // self.STRIDE])
        while at + 1 < len(self.before) and self.before[at + 1] <= i:
            at += 1
        word = int(self.high[at])
        for _ in range(i - int(self.before[at])):
            word &= word - 1
        place = at * 64 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        bit, k = i * self.low_bits, self.low_bits
        if not k:
            return 0
        at, off = bit >> 6, bit & 63
        word = int(self.low[at]) | (int(self.low[at + 1]) << 64 if at + 1 < len(self.low) else 0)
        return (word >> off) & ((1 << k) - 1)

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Elements i: as ``select``, for many places at once."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        at = np.searchsorted(self.before, i, "right") - 1
        word, left, place = self.high[at], i - self.before[at], np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the word around the bit that is sought
            ones = np.bitwise_count((word >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= ones
            left, place = left - np.where(beyond, ones, 0), place + np.where(beyond, width, 0)
        out = (at * 64 + place - i) << self.low_bits
        if self.low_bits:
            bit = i * self.low_bits
            at, off = bit >> 6, (bit & 63).astype(np.uint64)
            more = self.low[np.minimum(at + 1, len(self.low) - 1)]
            low = (self.low[at] >> off) | np.where(off > 0, more << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
            out = out | (low & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        return out

    def all(self) -> np.ndarray:
        """Every element at once."""
        return self.select_many(np.arange(self.count))

    def to_bytes(self) -> bytes:
        return SEQUENCE.pack(self.count, self.universe, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        count, universe, low_bits = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        lows = -(-count * low_bits // 64)
        highs = ((universe - 1 >> low_bits) + count - 1) // 64 + 1 if count else 0
        low = np.frombuffer(data, np.uint64, lows, at)
        high = np.frombuffer(data, np.uint64, highs, at + 8 * lows)
        return cls(count, universe, low_bits, low, high), at + 8 * (lows + highs)


def pack_image(doc_ids: list[int | None], documents: list[np.ndarray], id_bytes: int) -> bytes:
    """A file image of documents in ascending order of id, those without first."""
    missing = sum(x is None for x in doc_ids)
    known = doc_ids[missing:]
    least = known[0] if known else 0
    starts = np.cumsum([0, *map(len, documents)])
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    names = EliasFano.build(np.array([x - least for x in known], np.uint64))
    head = HEADER.pack(MAGIC, VERSION, id_bytes, len(documents), len(ids), least, missing)
    return b"".join((head, EliasFano.build(starts).to_bytes(), names.to_bytes(), ids.astype(f"<u{id_bytes}").tobytes()))


class Image:
    """A file image, read in place."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, size, self.documents, self.ids, self.least, self.missing = HEADER.unpack_from(view)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        self.starts, at = EliasFano.read(view, HEADER.size)
        self.names, at = EliasFano.read(view, at)
        self.array = np.frombuffer(view, f"<u{size}", self.ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.array[self.starts.select(i) : self.starts.select(i + 1)]

    def doc_ids(self, first: int = 0, end: int | None = None) -> list[int | None]:
        """Ids of the documents from ``first`` up to ``end``."""
        end = self.documents if end is None else end
        known = np.arange(max(first, self.missing), end) - self.missing
        return [None] * (end - first - len(known)) + [self.least + x for x in self.names.select_many(known).tolist()]


class _Encoder:
    """The tokenizer in one Python worker. Byte-level models split texts first
    and treat each piece alone, so pieces are encoded once; texts that hold
    characters for which engines' classes may differ go to the library whole."""

    kept: dict[str, _Encoder] = {}

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(definition)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.by_piece = plain and not spec.get("normalizer") and not spec["model"].get("dropout")
        self.split, self.pieces, self.used = splitter(BYTE_LEVEL), {}, 0
        self.odd = __import__("re").compile("[^\x00-ɏ]").search
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    @classmethod
    def get(cls, definition: bytes) -> _Encoder:
        key = hashlib.md5(definition).hexdigest()
        if key not in cls.kept:
            cls.kept[key] = cls(definition)
        return cls.kept[key]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        kind = np.dtype(f"<u{self.id_bytes}")
        if not self.by_piece:
            return [np.array(e.ids, kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        cut = [None if self.odd(t) else self.split(t) for t in texts]
        if self.used > REMEMBERED:
            self.pieces, self.used = {}, 0
        pieces = self.pieces
        # Set operations on whole lists, as most pieces are known.
        new = list(set().union(*[c for c in cut if c]).difference(pieces))
        if new:
            code = "H" if self.id_bytes == 2 else "I"
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                pieces[p] = ids = array(code, e.ids).tobytes()
                self.used += len(p) + len(ids) + Remembered.ROOM
        out = []
        for text, c in zip(texts, cut):
            if c is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, kind))
            else:
                out.append(np.frombuffer(b"".join(map(pieces.__getitem__, c)), kind))
        for p in new:
            if len(p) > Remembered.LONGEST:
                self.used -= len(p) + len(pieces.pop(p)) + Remembered.ROOM
        return out


class TokenFiles:
    """Writer and reader of a folder of token files."""

    def __init__(self, spark: SparkSession, tokenizer_path: str, end_id: int):
        ship_package(spark)
        with open(tokenizer_path, "rb") as file:
            definition = file.read(MAX_TOKENIZER_BYTES + 1)
        if len(definition) > MAX_TOKENIZER_BYTES:
            raise ValueError(f"{tokenizer_path} is too large to broadcast")
        self.spark, self.end_id = spark, end_id
        self.definition = spark.sparkContext.broadcast(definition)

    def write(self, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
        """Write ids of all documents, each followed by the end id, ascending by
        (doc_id, text); documents without id first, null texts as empty. Rows are
        (first_id, last_id, documents, before, ids, image): before counts the ids
        of the same task's earlier images, image is the file's bytes.
        Spark's writer carries them to whatever store ``path`` names, and a task
        that is run again leaves no half-written file."""
        definition, end_id = self.definition, self.end_id

        def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _Encoder.get(definition.value)
            end = np.array([end_id], f"<u{encoder.id_bytes}")
            names: list = []
            held: list = []
            size = before = 0

            def close() -> pa.RecordBatch:
                image = pack_image(names, held, encoder.id_bytes)
                row = {"first_id": names[0], "last_id": names[-1], "documents": len(names), "before": before, "ids": sum(map(len, held)), "image": image}
                return pa.RecordBatch.from_pylist([row], schema)

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [x or "" for x in part.column(1).to_pylist()]
                    for name, ids in zip(part.column(0).to_pylist(), encoder.batch(texts)):
                        ids = np.concatenate((ids, end))
                        if held and size + ids.nbytes > IMAGE_BYTES:
                            yield close()
                            before += sum(map(len, held))
                            names, held, size = [], [], 0
                        names.append(name)
                        held.append(ids)
                        size += ids.nbytes
            if held:
                yield close()

        schema = pa.schema([("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("before", pa.int64()), ("ids", pa.int64()), ("image", pa.binary())])
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
        partitions = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = rows.repartitionByRange(partitions, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "body")
        made = ordered.mapInArrow(images, "first_id long, last_id long, documents long, before long, ids long, image binary")
        made.write.option("compression", "zstd").parquet(path)

    def manifest(self, path: str) -> DataFrame:
        """The Parquet files of the folder (one for each writing task) with
        ``base``, the ids in all files before. Images aren't read."""
        from pyspark.sql import Window

        rows = self.spark.read.parquet(path).select("first_id", "last_id", "ids", F.col("_metadata.file_path").alias("file"))
        at = F.struct(F.col("first_id").isNotNull(), "first_id", F.col("last_id").isNotNull(), "last_id", "file")
        files = rows.groupBy("file").agg(F.min(at).alias("at"), F.sum("ids").alias("ids"))
        before = F.sum("ids").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        return files.select("file", F.coalesce(before, F.lit(0)).alias("base"))

    def read(self, path: str, doc_ids: str = "doc_id") -> DataFrame:
        """Per document, from the files: doc_id, start (ids before it over all
        files), n_tokens (with the end id), ids_crc32 (over 32-bit ids)."""
        schema = pa.schema([(doc_ids, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

        def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, data in zip(batch.column("start").to_pylist(), batch.column("image")):
                    image = Image(data.as_py())
                    for first in range(0, image.documents, AT_ONCE):
                        end = min(first + AT_ONCE, image.documents)
                        bounds = image.starts.select_many(np.arange(first, end + 1))
                        ids = image.array[bounds[0] : bounds[-1]].astype("<u4")
                        sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0])]
                        columns = [image.doc_ids(first, end), bounds[:-1] + start, np.diff(bounds), sums]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        images = self.spark.read.parquet(path).select("image", "before", F.col("_metadata.file_path").alias("of"))
        bases = self.manifest(path)
        if bases.count() <= MAX_BROADCAST_FILES:
            bases = F.broadcast(bases)
        placed = images.join(bases, F.col("of") == F.col("file")).select((F.col("base") + F.col("before")).alias("start"), "image")
        return placed.mapInArrow(documents, f"`{doc_ids}` long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    files, path = TokenFiles(spark, tokenizer_path, end_id), new_path(spark, "tokens")
    files.write(docs, path)
    return files.read(path)

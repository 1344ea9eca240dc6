"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``depth`` bytes long. A byte
is predicted in the deepest context of the tree; a byte not seen there costs
an escape and is predicted one context further up, without the bytes already
excluded (method C), down to a uniform choice. Statistics are frozen after
training, so the code length of a text is a sum over its bytes and is exact (but
for bytes rarer than LEAST, which cost as much as that). Contexts that occur fewer
than MIN_COUNT times in training are left out of a tree.

Because they are frozen, all escapes can be worked out beforehand: for each
context of a language's tree there is one row with the bits every byte costs.
Scoring a text is then two look-ups a byte and language: bytes before it ->
deepest context, (context, byte) -> bits.

The model is fitted on a documented, bounded sample: about ``sample_bytes`` of
text for each language, whole texts chosen by a hash, one at least. Every
language has a tree of its own of at most ``max_cells`` table cells (and a map of
4 bytes for each way ``depth`` of its bytes can follow each other), so other
languages, however many, take nothing from it. Trees go to Spark's broadcasts one
by one, and tasks hold those of ``BLOCK_BYTES`` at a time; a table between blocks keeps each text's best language so
far. Every text is scored whole, and blocks don't change results.

A text that is null or has no letter gets ``und`` and score 0. An empty
training set makes every answer ``und``. Ties go to the first language by name.
Repeated rows are predicted one by one, and a column named like the result is
replaced by it; others pass through under their own names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.kernels import shards, text_buffers
from vigil.session import materialize, ship_package

#: Bytes of training text for each language, about.
SAMPLE_BYTES = 4_000_000
DEPTH = 3
#: Cells of a language's bit table (contexts x bytes), 4 bytes each.
MAX_CELLS = 4_000_000
#: Bytes of trees that are broadcast together; a block has one tree at least.
BLOCK_BYTES = 256 << 20
#: Languages whose counts are on the driver at one time.
FITTED_TOGETHER = 16
#: Up to here the table of languages and shares is broadcast to draw the sample.
BROADCAST_LANGUAGES = 10_000
#: The best language so far, its bits, and the sum of all languages' posteriors as shares of its own.
BEST = "struct<lang:string,bits:double,rest:double>"
#: Training counts below this don't make a context.
MIN_COUNT = 3
#: Probabilities below this cost as much as it.
LEAST = 2.0**-40


def count_contexts(spark: SparkSession, rows: DataFrame, lang: str, text: str, depth: int) -> DataFrame:
    """(lang, gram, n): how often each gram, a byte and up to ``depth`` bytes
    before it (packed, the byte lowest), occurs; texts begin after ``depth``
    line breaks. Counted within shards first, then summed."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for name in langs.unique().to_pylist():
                own = batch.filter(pa.compute.equal(langs, name))
                for part in shards(own, "body"):
                    raw, bounds = text_buffers(part.column("body"))
                    code = _grams(raw, bounds, depth)
                    gram, n = np.unique(code, return_counts=True)
                    columns = [pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    slim = rows.select(F.col(lang).alias("lang"), F.col(text).alias("body"))
    return slim.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(raw: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """For each byte its gram; texts are set apart by ``depth`` line breaks."""
    lengths = np.diff(bounds)
    place = np.arange(len(raw)) + np.repeat(np.arange(1, len(lengths) + 1) * depth, lengths)
    line = np.full(len(raw) + len(lengths) * depth, 10, np.int64)
    line[place] = raw
    code = np.zeros(len(raw), np.int64)
    for back in range(depth, -1, -1):
        code = code << 8 | line[place - back]
    return code


class Model:
    """Frozen bit tables. ``symbol`` maps bytes to columns (0: never seen in
    training), ``node`` maps the packed symbols before a byte to its row."""

    def __init__(self, languages: list[str], symbol: np.ndarray, node: np.ndarray, bits: np.ndarray, depth: int):
        self.languages, self.symbol, self.node, self.bits, self.depth = languages, symbol, node, bits, depth

    @classmethod
    def fit(cls, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, depth: int, max_cells: int = MAX_CELLS, min_count: int = MIN_COUNT) -> Model:
        """From counts: arrays of language index, gram and count."""
        size = 256
        seen = np.unique(np.concatenate([(gram >> 8 * k) & 255 for k in range(depth + 1)]))  # in any place
        symbol = np.zeros(size, np.int64)
        symbol[seen] = np.arange(1, len(seen) + 1)
        width, many = len(seen) + 1, max(1, len(languages))
        target = symbol[gram & 255]
        context = [symbol[(gram >> 8 * (k + 1)) & 255] for k in range(depth)]  # nearest byte first
        node = np.zeros(width**depth, np.int32)
        unseen = max(1, size - len(seen))
        uniform = np.full((many, width), 1 / size)
        uniform[:, 0] = unseen / size  # any byte not seen: each costs its share below

        def rows_of(group: np.ndarray, count: int, below: np.ndarray) -> np.ndarray:
            """(count, many, width) probabilities of contexts, given those one up."""
            tally = np.zeros(count * many * width)
            np.add.at(tally, (group * many + lang_of) * width + target_of, n_of)
            tally = tally.reshape(count, many, width)
            total, kinds = tally.sum(2, keepdims=True), (tally > 0).sum(2, keepdims=True)
            escape = np.divide(kinds, total + kinds, out=np.ones_like(total), where=total > 0)
            left = np.where(tally > 0, 0, below).sum(2, keepdims=True)
            share = np.divide(escape, left, out=np.zeros_like(escape), where=left > 0)
            scale = np.where(left > 0, total + kinds, total)  # all symbols seen: nothing escapes
            return np.where(tally > 0, tally / np.maximum(scale, 1), below * share)

        lang_of, target_of, n_of = lang, target, n
        root = rows_of(np.zeros(len(gram), np.int64), 1, uniform[None])
        tables, parent, parent_keys = [root], root, np.zeros(1, np.int64)
        used, budget = 1, max(1, max_cells // (many * width))
        for k in range(1, depth + 1):
            key = np.zeros(len(gram), np.int64)
            for j in range(k - 1, -1, -1):  # nearest byte in the lowest place
                key = key * width + context[j]
            keys, which = np.unique(key, return_inverse=True)
            weight = np.bincount(which, n, minlength=len(keys))
            up = keys % width ** (k - 1)
            at = np.searchsorted(parent_keys, up)
            at[at == len(parent_keys)] = 0
            good = (weight >= min_count) & (parent_keys[at] == up)
            good &= _heaviest(weight, good, budget - used)
            if not good.any():
                break
            keep = np.flatnonzero(good)
            new = np.full(len(keys), -1)
            new[keep] = np.arange(len(keep))
            mine = new[which] >= 0
            lang_of, target_of, n_of = lang[mine], target[mine], n[mine]
            table = rows_of(new[which][mine], len(keep), parent[at[keep]])
            spread = width ** (depth - k)  # every way to go on to the full depth
            node.reshape(spread, width**k)[:, keys[keep]] = used + np.arange(len(keep))
            tables.append(table)
            parent, parent_keys = table, keys[keep]
            used += len(keep)
        probability = np.concatenate(tables)
        probability[:, :, 0] /= unseen
        bits = -np.log2(np.maximum(probability, LEAST)).transpose(0, 2, 1)
        return cls(languages, symbol, node, np.ascontiguousarray(bits.reshape(-1, many), np.float32), depth)

    @property
    def size(self) -> int:
        return self.node.nbytes + self.bits.nbytes + self.symbol.nbytes

    def lengths(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code lengths in bits, texts by languages."""
        width, depth = int(self.symbol.max()) + 1, self.depth
        sizes = np.diff(bounds)
        place = np.arange(len(raw)) + np.repeat(np.arange(1, len(sizes) + 1) * depth, sizes)
        line = np.full(len(raw) + len(sizes) * depth, self.symbol[10], np.int64)
        line[place] = self.symbol[raw]
        context = np.zeros(len(raw), np.int64)
        for back in range(depth, 0, -1):
            context = context * width + line[place - back]
        cell = self.node[context].astype(np.int64) * width + line[place]
        out = np.zeros((len(sizes), self.bits.shape[1]))
        for k in range(self.bits.shape[1]):
            total = np.concatenate(([0.0], np.cumsum(self.bits[:, k][cell], dtype=np.float64)))
            out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        return out


def _heaviest(weight: np.ndarray, good: np.ndarray, room: int) -> np.ndarray:
    """Flags of the ``room`` heaviest of the good ones."""
    out = np.zeros(len(weight), bool)
    at = np.flatnonzero(good)
    out[at[np.argsort(-weight[at], kind="stable")[: max(0, room)]]] = True
    return out


class LanguageIdentifier:
    """Fit on labelled rows, predict on texts."""

    def __init__(self, spark: SparkSession, models: Iterable[Model]):
        """models: one for each language, by name. Each is handed to Spark's
        broadcasts, which keep it on disk where memory is short, before the
        next is made; the driver keeps none."""
        self.spark = spark
        self.models = [(spark.sparkContext.broadcast(model), model.size) for model in models]

    @classmethod
    def fit(
        cls, spark: SparkSession, rows: DataFrame, key: str, text: str = "text", lang: str = "lang",
        depth: int = DEPTH, sample_bytes: int = SAMPLE_BYTES, max_cells: int = MAX_CELLS,
    ) -> LanguageIdentifier:
        """rows: labelled texts; ``key`` identifies a row for the hash that
        picks the sample. Languages of null are left out."""
        ship_package(spark)
        draw = F.pmod(F.xxhash64(F.lit("language sample"), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
        slim = rows.select(draw.alias("draw"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("body"))
        slim = slim.where(F.col("lang").isNotNull() & F.col("body").isNotNull())
        # A row a language. Its text of the least draw is in the sample whatever its length.
        size = slim.groupBy("lang").agg(F.sum(F.octet_length("body")).alias("size"), F.min("draw").alias("least"))
        limit = F.greatest("least", F.lit(float(sample_bytes)) / F.greatest("size", F.lit(1)))
        limits = materialize(spark, size.select("lang", limit.alias("limit")), "languages")
        languages = sorted(r["lang"] for r in limits.select("lang").toLocalIterator())
        small = F.broadcast(limits) if len(languages) <= BROADCAST_LANGUAGES else limits
        sample = slim.join(small, "lang").where(F.col("draw") <= F.col("limit"))
        counts = count_contexts(spark, sample, "lang", "body", depth)
        if len(languages) > FITTED_TOGETHER:
            counts = materialize(spark, counts, "contexts")

        def models() -> Iterator[Model]:
            for i in range(0, len(languages), FITTED_TOGETHER):
                names = languages[i : i + FITTED_TOGETHER]
                found = counts.where(F.col("lang").isin(names)).toArrow() if len(languages) > FITTED_TOGETHER else counts.toArrow()
                for name in names:
                    own = found.filter(pa.compute.equal(found.column("lang"), name))
                    gram, n = own.column("gram").to_numpy(), own.column("n").to_numpy().astype(np.float64)
                    if len(gram):  # else all its texts are empty
                        yield Model.fit([name], np.zeros(len(gram), np.int64), gram, n, depth, max_cells)

        return cls(spark, models())

    def _blocks(self, block_bytes: int) -> list[list]:
        """Broadcasts of models, those of a block together."""
        blocks, size = [[]], 0
        for model, own in self.models:
            if blocks[-1] and size + own > block_bytes:
                blocks.append([])
                size = 0
            blocks[-1].append(model)
            size += own
        return blocks

    def predict(self, df: DataFrame, text: str = "text", out: str = "language", block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """``df`` with a struct column ``out`` (lang_pred, score)."""
        taken = {c.lower() for c in df.columns}
        best = "_best"
        while best in taken:
            best += "_"
        df = df.withColumn(best, F.lit(None).cast(BEST))
        blocks = self._blocks(block_bytes)
        for i, models in enumerate(blocks):
            scored = F.arrow_udf(_better(models), BEST)(F.col(text).cast("string"), F.col(best))
            df = df.withColumn(best, scored)
            if i + 1 < len(blocks):  # the next block needs its memory
                df = materialize(self.spark, df, "languages")
        lang, rest = F.coalesce(F.col(f"{best}.lang"), F.lit("und")), F.col(f"{best}.rest")
        found = F.struct(lang.alias("lang_pred"), F.coalesce(1 / rest, F.lit(0.0)).alias("score"))
        return df.withColumn(out, found).drop(best)


def _better(sent):
    """Function of texts and BEST before a block of models -> BEST behind it;
    null for a text without a letter."""
    kind = pa.struct([("lang", pa.string()), ("bits", pa.float64()), ("rest", pa.float64())])

    def better(column: pa.Array, before: pa.Array) -> pa.Array:
        import regex

        models, letter = [x.value for x in sent], regex.compile(r"\p{L}").search
        out = []
        for part in shards(pa.record_batch([column, before], ["text", "before"])):
            texts, earlier = part.column(0), part.column(1).to_pylist()
            known = [bool(models) and bool(x) and letter(x) is not None for x in texts.to_pylist()]
            raw, bounds = text_buffers(texts)
            bits = np.concatenate([m.lengths(raw, bounds) for m in models], 1) if models else np.zeros((len(known), 1))
            first, low = bits.argmin(1), bits.min(1)
            rest = np.exp2(np.clip(low[:, None] - bits, -1000, 0)).sum(1)
            for k, f, b, r, old in zip(known, first.tolist(), low.tolist(), rest.tolist(), earlier):
                if not k:
                    out.append(None)
                elif old is None:
                    out.append({"lang": models[f].languages[0], "bits": b, "rest": r})
                elif old["bits"] <= b:  # ties: the earlier name
                    out.append({**old, "rest": old["rest"] + r * 2.0 ** max(old["bits"] - b, -1000)})
                else:
                    out.append({"lang": models[f].languages[0], "bits": b, "rest": r + old["rest"] * 2.0 ** max(b - old["bits"], -1000)})
        return pa.array(out, kind)

    return better

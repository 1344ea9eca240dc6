"""Quality classifier from positive and unlabelled texts.

Trusted positives are the rows labelled 1; everything else is unlabelled web
text. A first logistic separator of both gives a ranking, from which the class
prior is estimated: for every threshold the share of unlabelled texts above it
is at least the prior times the share of positives above it, so the least
ratio over thresholds (with a margin for sampling error) bounds the prior.
The final network minimises the non-negative unbiased risk: the positives'
loss, plus the unlabelled texts' loss as negatives less what positives among
them are expected to add, held at zero or above.

Features are shares of byte classes and counts of words, lines and repeats
over whole texts. The fit uses two hash samples, whose sizes are parameters:
of all documents, as the unlabelled texts, about ``sample`` at most, and of
the documents labelled 1 about ``positives`` at most, so that all of them
serve however few they are beside the corpus. Scoring covers every text.

Null texts count as empty, and an empty text gets the score of its features.
Labels that are null, or that belong to no document, are ignored; a document
with several labels counts as positive only if all are 1. Without any
positive label every score is the prior 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.kernels import NOT_SPACE, mix, owner, shards, text_buffers, words
from vigil.session import ship_package

#: Documents of the hash sample that the fit reads as unlabelled, about.
SAMPLE = 12_000
#: Documents labelled 1 that the fit reads, about.
POSITIVES = 12_000
HIDDEN = 16

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:", "!", "?", "'\"`", "()[]{}", "#$%&*", "|", "<>", "=+-/_@\\^~")
_CLASS = np.full(256, len(_CLASSES), np.int64)
_CLASS[128:] = len(_CLASSES) + 1
for _i, _codes in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _codes]] = _i
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False
FEATURES = len(_CLASSES) + 2 + 9


def _distinct(code: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Distinct codes in each text."""
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=count)


def features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    count, sizes = len(bounds) - 1, np.diff(bounds)
    kinds = len(_CLASSES) + 2
    text = np.repeat(np.arange(count), sizes)
    shares = np.bincount(text * kinds + _CLASS[raw], minlength=count * kinds).reshape(count, kinds) / np.maximum(sizes, 1)[:, None]
    start, end, code, at = words(raw, bounds, NOT_SPACE, lower=False)
    n, of = np.diff(at), owner(at)
    some = np.maximum(n, 1)
    total = lambda flags, rows: np.bincount(rows, flags, minlength=count)
    pair = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    same = total(code[pair + 1] == code[pair], of[pair]) / some
    bigram = mix(code[pair] * np.uint64(3) + code[pair + 1])
    five = np.flatnonzero(of[4:] == of[:-4]) if len(of) > 4 else np.zeros(0, np.int64)
    window = np.zeros(len(five), np.uint64)
    for k in range(5):
        window = window * np.uint64(0x9E3779B97F4A7C15) + code[five + k]
    _, _, line_code, line_at = words(raw, bounds, _NOT_BREAK, lower=False)
    lines = np.diff(line_at)
    line_words = np.log1p(n / np.maximum(lines, 1))
    length = np.log1p(np.bincount(of, end - start, minlength=count) / some)
    spare = lambda distinct, n: 1 - distinct / np.maximum(n, 1) * (n > 0) - (n == 0)
    pairs, fives = np.bincount(of[pair], minlength=count), np.bincount(of[five], minlength=count)
    own = [
        np.log1p(n), length, same,
        spare(_distinct(code, of, count), n) / np.maximum(np.log1p(n), 1),
        spare(_distinct(bigram, of[pair], count), pairs),
        spare(_distinct(mix(window), of[five], count), fives),
        spare(_distinct(line_code, owner(line_at), count), lines),
        line_words, np.log1p(lines),
    ]
    return np.column_stack((shares, *own)).astype(np.float32)


def feature_column(text: Column) -> Column:
    def make(column: pa.Array) -> pa.Array:
        rows = [features(*text_buffers(p.column(0))) for p in shards(pa.record_batch([column], ["text"]))]
        flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FEATURES), pa.int32()), pa.array(flat))

    return F.arrow_udf(make, "array<float>")(text.cast("string"))


class Network:
    """Standardised features, one hidden layer, a score from 0 to 1."""

    def __init__(self, mean, scale, layers):
        self.mean, self.scale, self.layers = mean, scale, layers

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b, 0) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _adam(x: np.ndarray, layers: list, slopes, steps: int, rate: float, decay: float) -> list:
    """Minimise: ``slopes(logits, step)`` gives the loss's slope at each logit."""
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, steps + 1):
        a, b, c, d = layers
        inner = x @ a + b
        active = np.maximum(inner, 0)
        slope = slopes(active @ c + d)
        back = np.outer(slope, c) * (inner > 0)
        parts = [x.T @ back + decay * a, back.sum(0), active.T @ slope + decay * c, np.array(slope.sum())]
        for i, g in enumerate(parts):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def _start(width: int, seed: int) -> list:
    draw = np.random.default_rng(seed)
    return [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.05) -> float:
    """Upper bound of the share of positives among the unlabelled, from scores
    of both: the least ratio of shares above a threshold, with its margin."""
    order = np.unique(np.quantile(positive, np.linspace(0, 0.9, 91)))
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    p = 1 - np.searchsorted(positive, order) / len(positive)
    u = 1 - np.searchsorted(unlabelled, order) / len(unlabelled)
    slack = np.sqrt(np.log(2 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.01, 0.99))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _apart(m: int, n: int):
    """Slopes of the logistic loss that tells m positives from n unlabelled."""
    return lambda z: np.concatenate(((_sigmoid(z[:m]) - 1) / m, _sigmoid(z[m:]) / n)) / 2


def _risks(z: np.ndarray, m: int, prior: float) -> tuple[float, float]:
    """(risk of the positives as positives, unbiased risk of the negatives)."""
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  as a negative; as a positive it is loss(-z)
    return prior * loss(-z[:m]).mean(), loss(z[m:]).mean() - prior * loss(z[:m]).mean()


def _non_negative(m: int, n: int, prior: float):
    """Slopes of the non-negative unbiased risk."""

    def slopes(z):
        p, u = _sigmoid(z[:m]), _sigmoid(z[m:])
        if _risks(z, m, prior)[1] < 0:  # step back: raise the negatives' risk to zero
            return np.concatenate((prior * p / m, -u / n))
        return np.concatenate((prior * (p - 1) / m - prior * p / m, u / n))

    return slopes


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, seed: int = 1) -> tuple[Network, float]:
    """(network, class prior) from feature rows of positives and unlabelled.
    Scores for the prior come from separators fitted on the other half, and
    the weight decay is the one with the least risk on the other half."""
    positive, unlabelled = positive.astype(np.float32), unlabelled.astype(np.float32)
    mean, scale = positive.mean(0), positive.std(0) + 1e-2
    norm = lambda x: np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    p, u = norm(positive)[draw.permutation(len(positive))], norm(unlabelled)[draw.permutation(len(unlabelled))]
    halves = [(p[k::2], u[k::2]) for k in (0, 1)] if len(p) > 1 else [(p, u)] * 2
    raw = lambda layers, x: Network(0.0, 1.0, layers).logit(x)
    seen_p, seen_u = [], []
    for (a, b), (c, d) in (halves, halves[::-1]):
        layers = _adam(np.concatenate((a, b)), _start(p.shape[1], seed), _apart(len(a), len(b)), steps, 0.02, 1e-2)
        seen_p.append(raw(layers, c))
        seen_u.append(raw(layers, d))
    prior = estimate_prior(np.concatenate(seen_p), np.concatenate(seen_u))
    least = None
    for decay in (1e-3, 1e-2, 3e-2):
        total = 0.0
        for (a, b), (c, d) in (halves, halves[::-1]):
            layers = _adam(np.concatenate((a, b)), _start(p.shape[1], seed), _non_negative(len(a), len(b), prior), steps, 0.02, decay)
            good, bad = _risks(raw(layers, np.concatenate((c, d))), len(c), prior)
            total += good + max(0.0, bad)
        if least is None or total < least[0]:
            least = total, decay
    layers = _adam(np.concatenate((p, u)), _start(p.shape[1], seed), _non_negative(len(p), len(u), prior), steps, 0.02, least[1])
    return Network(mean, scale, layers), prior


class QualityClassifier:
    def __init__(self, spark: SparkSession, network: Network | None, prior: float):
        self.spark, self.network, self.prior = spark, network, prior

    @classmethod
    def fit(
        cls, spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
        positives: int = POSITIVES,
    ) -> QualityClassifier:
        """docs: texts to learn from (all unlabelled); labels: (key, label)
        of the rows whose labels may be used. Only label 1 is."""
        ship_package(spark)
        draw = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), F.col(of)), F.lit(1 << 30)) / float(1 << 30)
        share = lambda wanted, count: F.lit(min(1.0, wanted / max(1, count)))
        marked = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(F.col("_label").isNotNull())
        marked = marked.groupBy("_key").agg(F.min("_label").alias("_label")).where("_label = 1").select("_key")
        # Labels without a document don't count towards the bound.
        marked = marked.join(docs.select(key), F.col("_key") == F.col(key), "left_semi")
        marked = marked.where(draw("quality positives", "_key") < share(positives, marked.count()))
        own = docs.select(F.col(key), F.col(text), (draw("quality sample", key) < share(sample, docs.count())).alias("_drawn")).where(F.col(key).isNotNull())
        # Keys of about ``positives`` documents.
        got = own.join(F.broadcast(marked), F.col(key) == F.col("_key"), "left").withColumn("good", F.col("_key").isNotNull())
        got = got.where(F.col("_drawn") | F.col("good")).select("good", "_drawn", feature_column(F.col(text)).alias("x")).toArrow()
        x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
        good, drawn = got.column("good").to_numpy(), got.column("_drawn").to_numpy()
        # Rows in one order whatever the partitions, so that a fit can be repeated.
        order = np.lexsort((drawn, good, *x.T))
        x, good, drawn = x[order], good[order], drawn[order]
        if not good.any():
            return cls(spark, None, 0.5)
        network, prior = fit(x[good], x[drawn])
        return cls(spark, network, prior)

    def score(self, df: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """``df`` with column ``out``: 0 to 1, higher for better texts."""
        if self.network is None:
            return df.withColumn(out, F.lit(self.prior))
        sent = self.spark.sparkContext.broadcast(self.network)

        def score(column: pa.Array) -> pa.Array:
            parts = [sent.value.score(features(*text_buffers(p.column(0)))) for p in shards(pa.record_batch([column], ["text"]))]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

        return df.withColumn(out, F.arrow_udf(score, "double")(F.col(text).cast("string")))

"""Personal data by base patterns and bootstrapped contextual extraction.

Base spans: leftmost non-overlapping matches of one pattern per kind, then a
check (address parts, Luhn sum, digit count) that drops a match for good.

Bootstrapping: the base spans are the seed entities. A fifth kind, secret, has
seeds but no base spans: quoted values of 20 characters or more behind a
credential's name and = or : (SECRET), taken from one half of the documents only
(by a hash of the text); the values of the other half, and of other forms, are for
the method to discover, and secrets count only where an induced pattern finds
them. The words before a seed (one, and the last two) are its lexical patterns;
opening quotes and brackets before the seed belong to its own token. Candidates
are identifier-like tokens: five characters or more with a digit, without
punctuation at either edge, up to a closing quote if a quote opens them, outside
base spans. The shape of a token (quoted or not, its class of characters, its
length) is a pattern as well: it lends evidence, but discovers nothing. Spark
scores the bipartite graph of patterns and instances (seeds and candidates)
iteratively: a pattern's confidence is the sum of the scores of the instances
it precedes over the number of all tokens it precedes in the corpus, so common
words, which precede everything, earn nothing; an instance's score is
1 - product(1 - confidence) over its patterns, seeds staying at 1. What a
pattern itself (or one that ends with the same word) lends to an instance
doesn't count for that pattern, so patterns can't confirm themselves. Rounds
end when no confidence moves by more than SETTLED; if that takes more than
ROUNDS, the last round's confidences count. Patterns that reach
``confidence`` and precede at least ``support`` distinct seeds of one kind
discover further spans of that kind: candidates that follow them.

Pattern totals are counted over all documents; tokens enter Spark as hashes,
counted within workers first. A pattern is the more certain of its kinds (the
one with more distinct seeds, then the later name); of two patterns before one
candidate the longer decides. Induced patterns number at most two for every
``support`` distinct seeds and reach the workers in broadcasts of bounded size.
Null texts count as empty, repeated rows are handled one by one, and without
seeds nothing is added. A column named like ``out`` is replaced; other columns
stay. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bitfilter
from vigil.llm.kernels import NOT_SPACE, mix, shards, text_buffers, words
from vigil.session import materialize, ship_package

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only patterns find come after the base kinds.
SPAN_KINDS = (*KINDS, "secret")
# Fixed patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"  # a match can only begin where a run of digits does
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"""(?i)(?:token|secret|password|passwd|api[_-]?key)[\x20]*[=:][\x20]*["']([A-Za-z0-9_+/=-]{20,})["']"""

#: A pattern must precede this many distinct seeds of its kind, and reach this
#: confidence, before it may discover anything.
SUPPORT, CONFIDENCE = 8, 0.75
#: Rounds of scoring at most, and the change of a confidence that ends them.
ROUNDS, SETTLED = 20, 0.001
#: Patterns in one broadcast.
PATTERN_BLOCK = 100_000
#: Distinct pattern hashes a worker counts before it hands them on.
COUNTED = 1 << 20

_find = {"ip": re.compile(IP).finditer, "card": re.compile(CARD).finditer, "phone": re.compile(PHONE).finditer}
_secrets = re.compile(SECRET).finditer
_blank = re.compile(r"[\x20\x09-\x0D]").search
_digit = re.compile(r"[0-9]").search
_BLANK = " \t\n\x0b\x0c\r"
_QUOTES = "\"'"
#: What shape patterns begin with; no word of a text holds it next to a shape's own form.
_SHAPE = "\x00"
#: Punctuation that ends a token; the rest ("+/=_-@") occurs at the ends of values.
_edge = "!\"#$%&'()*,.:;<>?[\\]^`{|}~"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _holds(kind: str, match: str) -> bool:
    if kind == "ip":
        # Python reads no number of more than 4,300 digits.
        parts = [p.lstrip("0") for p in match.split(".")]
        return all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts)
    if kind == "card":
        d = _digits(match)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(match)) <= 15
    return True


def _emails(text: str):
    """Email matches; the pattern runs only from the start of the run of local
    characters before each @, where its leftmost match must begin."""
    match, at, end = re.compile(EMAIL).match, 0, 0
    while (at := text.find("@", at)) >= 0:
        start = max(end, at)
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = match(text, start) if start < at else None
        if found:
            end = found.end()
            yield found
        at = max(at + 1, end)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by kind as listed."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), 0) for m in _emails(text)]
    if _digit(text):
        for k in (1, 2, 3):
            kind = KINDS[k]
            out += [(m.start(), m.end(), k) for m in _find[kind](text) if _holds(kind, m.group())]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def secret_seeds(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Values that credentials' names introduce, outside the spans and with a
    digit; none in documents of the half that is left for discovery."""
    if '"' not in text and "'" not in text or zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1:
        return []
    found = [m.span(1) for m in _secrets(text) if _digit(m.group(1))]
    return [(a, b, "secret") for a, b in found if not any(s[0] < b and a < s[1] for s in spans)]


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-like tokens outside the spans, without edge punctuation."""
    out, at = [], 0
    if not _digit(text):
        return out
    end = 0
    while found := _digit(text, end):
        a = found.start()
        while a > end and text[a - 1] not in _BLANK:
            a -= 1
        stop = _blank(text, found.end())
        b = end = stop.start() if stop else len(text)
        while a < b and text[a] in _edge:
            a += 1
        if a and text[a - 1] in _QUOTES and (close := text.find(text[a - 1], a, b)) >= 0:
            b = close
        while b > a and text[b - 1] in _edge:
            b -= 1
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if b - a >= 5 and not any(s[0] < b and a < s[1] for s in spans[at : at + 8]) and _digit(text[a:b]):
            out.append((a, b))
    return out


def _word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all one-word and two-word contexts that a token follows."""
    raw, bounds = text_buffers(column)
    _, _, code, at = words(raw, bounds, NOT_SPACE)
    last = np.zeros(len(code) + 1, bool)
    last[at] = True
    follows = ~last[1:]  # another word of the same text comes next
    two = np.flatnonzero(follows & np.concatenate(([False], follows[:-1])) if len(code) else follows)
    return code[follows], mix(code[two - 1] * np.uint64(3) + code[two])


def _pattern_code(pattern: str) -> int:
    """The hash of a pattern that ``_word_codes`` gives its occurrences."""
    raw, bounds = text_buffers(pa.array([pattern], pa.large_string()))
    code = words(raw, bounds, NOT_SPACE)[2]
    value = code[0] if len(code) == 1 else mix(code[:1] * np.uint64(3) + code[1:2])[0]
    return int(np.uint64(value).view(np.int64))


def _ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}


def graph_edges(docs: DataFrame, text: str) -> DataFrame:
    """(pattern, instance, kind, n): patterns with the instances they precede;
    kind is null for candidates. Instances are hashes of the lowered token."""
    schema = pa.schema([("pattern", pa.string()), ("instance", pa.int64()), ("kind", pa.string()), ("n", pa.int64())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict = {}
            for value in batch.column(0):
                body = value.as_py()
                if not body or not _digit(body) and "@" not in body:
                    continue
                spans = base_spans(body)
                spans += secret_seeds(body, spans)
                seeds = sorted(spans)
                for a, b, kind in seeds + [(a, b, None) for a, b in candidates(body, seeds)]:
                    instance = _hash(body[a:b].lower())
                    for pattern in (*contexts(body, a), shape(body, a, b)):
                        key = (pattern, instance, kind)
                        found[key] = found.get(key, 0) + 1
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(3)] + [pa.array(list(found.values()), pa.int64())], schema=schema
                )

    made = docs.select(F.col(text).cast("string")).mapInArrow(edges, "pattern string, instance long, kind string, n long")
    return made.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n"))


def contexts(text: str, start: int) -> list[str]:
    """Patterns of the place ``start``: the word before it and the two before,
    A-Z lowered, however long. White space, or edge punctuation behind white
    space, must part them from what starts there."""
    at = start
    while at > 0 and text[at - 1] in _edge:
        at -= 1
    if at == 0 or text[at - 1] not in _BLANK:
        return []
    before: list[str] = []
    while len(before) < 2:
        while at > 0 and text[at - 1] in _BLANK:
            at -= 1
        end = at
        while at > 0 and text[at - 1] not in _BLANK:
            at -= 1
        if at == end:
            break
        before.insert(0, _ascii_lower(text[at:end]))
    return [" ".join(before[-n:]) for n in (1, 2) if len(before) >= n]


_CLASSES = (("d", re.compile(r"[0-9]+")), ("h", re.compile(r"[0-9a-f]+|[0-9A-F]+")), ("a", re.compile(r"[0-9A-Za-z]+")), ("b", re.compile(r"[0-9A-Za-z_+/=-]+")))


def shape(text: str, start: int, end: int) -> str:
    """The pattern of a token's own form."""
    kind = next((k for k, fits in _CLASSES if fits.fullmatch(text, start, end)), "o")
    return f"{_SHAPE}{'q' if start and text[start - 1] in _QUOTES else ''}{kind}{end - start}"


def pattern_totals(spark: SparkSession, docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(code, total): how many tokens follow each one- or two-word context,
    for those in ``patterns`` (column code) and a few others."""
    sent = bitfilter.build(spark, patterns, "code")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list = []
        waiting = 0

        def settle():
            nonlocal codes, counts, fresh, waiting
            value, which = np.unique(np.concatenate((codes, *fresh)), return_inverse=True)
            weight = np.concatenate((counts, np.ones(waiting, np.int64)))
            codes, counts = value, np.bincount(which, weight, len(value)).astype(np.int64)
            fresh, waiting = [], 0

        for batch in batches:
            for part in shards(batch, "body"):
                for code in _word_codes(part.column(0)):
                    code = code[bitfilter.passes(sent.value, code.view(np.int64))]
                    fresh.append(code)
                    waiting += len(code)
                if waiting > COUNTED * 2:
                    settle()
                if len(codes) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "total"])
                    codes, counts = codes[:0], counts[:0]
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "total"])

    made = docs.select(F.col(text).cast("string").alias("body")).mapInArrow(totals, "code long, total long")
    return made.groupBy("code").agg(F.sum("total").alias("total"))


def _family():
    """Patterns that end with the same word speak for the same evidence."""
    return F.substring_index("pattern", " ", -1)


def all_spans_of(text: str, patterns: list[dict]) -> tuple[list, list]:
    """(base spans, base spans and what the patterns find) of one text. The
    longest pattern before a candidate decides, then the most confident."""
    own = base_spans(text)
    added = []
    if any(patterns):
        for a, b in candidates(text, own):
            hits = [found for p in contexts(text, a) for block in patterns if (found := block.get(p))]
            if hits:
                added.append((a, b, max(hits)[2]))
    if not added:
        return own, own
    return own, sorted(own + added, key=lambda s: (s[0], SPAN_KINDS.index(s[2])))


class Extractor:
    def __init__(self, spark: SparkSession, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS):
        ship_package(spark)
        self.spark, self.support, self.confidence, self.rounds = spark, support, confidence, rounds

    def induce(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(pattern, kind, confidence) of the patterns fit to discover."""
        spark = self.spark
        edges = materialize(spark, graph_edges(docs, text), "edges")
        seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("seeds"))
        best = seeds.groupBy("pattern").agg(F.max_by("kind", F.struct("seeds", "kind")).alias("kind"), F.max("seeds").alias("seeds")).where(F.col("seeds") >= self.support)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = [_pattern_code(p) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], [*batch.schema.names, "code"])

        is_shape = F.startswith("pattern", F.lit(_SHAPE))
        known = "pattern string, kind string, confidence double"
        patterns = materialize(spark, best.where(~is_shape).mapInArrow(coded, "pattern string, kind string, seeds long, code long"), "patterns")
        if patterns.isEmpty():
            return spark.createDataFrame([], known)
        totals = pattern_totals(spark, docs, text, patterns).join(patterns.select("code"), "code")
        contexts_ = patterns.join(totals, "code").select("pattern", F.col("kind").alias("of"), "seeds", "total")
        # All tokens of a shape with a digit are in the graph themselves.
        shapes = best.where(is_shape).join(edges.groupBy("pattern").agg(F.sum("n").alias("total")), "pattern").select("pattern", F.col("kind").alias("of"), "seeds", "total")
        patterns = materialize(spark, contexts_.unionByName(shapes), "patterns")
        graph = materialize(spark, edges.join(patterns.select("pattern", "of", "total"), "pattern").where("kind is null or kind = of"), "graph")
        score = F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)
        scored = graph.select("pattern", "of", "total", "instance", "kind", "n", score.alias("score"))
        before = None
        for _ in range(self.rounds):
            confidence = scored.groupBy("pattern", "of").agg(F.least(F.sum(F.col("score") * F.col("n")) / F.max("total"), F.lit(1.0)).alias("confidence"))
            confidence = materialize(spark, confidence, "confidence")
            if before is not None:
                moved = confidence.join(before.withColumnRenamed("confidence", "old"), ["pattern", "of"]).agg(F.max(F.abs(F.col("confidence") - F.col("old")))).first()[0]
                if (moved or 0.0) <= SETTLED:
                    break
            before = confidence
            joined = graph.where("kind is null").join(confidence, ["pattern", "of"]).select("instance", "of", _family().alias("family"), "confidence")
            miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
            own = joined.groupBy("instance", "of", "family").agg(miss.alias("own"))
            every = own.groupBy("instance", "of").agg(F.sum("own").alias("all"))
            others = own.join(every, ["instance", "of"]).select("instance", "of", "family", (1 - F.exp(F.col("all") - F.col("own"))).alias("found"))
            scored = graph.withColumn("family", _family()).join(others, ["instance", "of", "family"], "left").select(
                "pattern", "of", "total", "instance", "kind", "n", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("score")
            )
        return confidence.where((F.col("confidence") >= self.confidence) & ~is_shape).select("pattern", F.col("of").alias("kind"), "confidence")

    def _patterns(self, docs: DataFrame, text: str) -> list:
        """Broadcasts of {pattern: (words, confidence, kind)}, streamed in blocks."""
        blocks, block = [], {}
        for row in self.induce(docs, text).toLocalIterator():
            block[row["pattern"]] = (row["pattern"].count(" ") + 1, row["confidence"], row["kind"])
            if len(block) == PATTERN_BLOCK:
                blocks.append(self.spark.sparkContext.broadcast(block))
                block = {}
        if block:
            blocks.append(self.spark.sparkContext.broadcast(block))
        return blocks

    def find(self, docs: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
        """``docs`` with a struct column ``out``: base and spans, arrays of
        (start, stop, kind) by start and kind; spans holds the base and what
        the induced patterns add."""
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        whole = "struct<base:array<struct<start:int,stop:int,kind:string>>,spans:array<struct<start:int,stop:int,kind:string>>>"
        blocks = self._patterns(docs, text)

        def spans_of(texts: pa.Array) -> pa.Array:
            patterns = [x.value for x in blocks]
            pack = lambda spans: [{"start": a, "stop": b, "kind": k} for a, b, k in spans]
            base, every = [], []
            for value in texts:
                own, all_spans = all_spans_of(value.as_py() or "", patterns)
                base.append(pack(own))
                every.append(pack(all_spans))
            return pa.StructArray.from_arrays([pa.array(base, kind), pa.array(every, kind)], ["base", "spans"])

        return docs.withColumn(out, F.arrow_udf(spans_of, whole)(F.col(text).cast("string")))

    def mask(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with every span replaced by its kind in brackets; texts
        without spans (nulls as well) stay as they are. Of overlapping spans
        the first is named."""
        blocks = self._patterns(docs, text)

        def masked(texts: pa.Array) -> pa.Array:
            patterns = [x.value for x in blocks]
            out = []
            for value in texts:
                body, parts, at = value.as_py(), [], 0
                for a, b, kind in all_spans_of(body, patterns)[1] if body else ():
                    if a >= at:
                        parts += [body[at:a], f"[{kind.upper()}]"]
                    at = max(at, b)
                out.append("".join([*parts, body[at:]]) if parts else body)
            return pa.array(out, pa.string())

        return docs.withColumn(text, F.arrow_udf(masked, "string")(F.col(text).cast("string"))).select(*docs.columns)

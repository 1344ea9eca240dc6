"""Quality rules with risk-controlled thresholds, in native expressions only.

Four statistics (shares of symbols, duplicate lines, repeated words, capitals)
are binned. Labelled rows are dealt in two by the CRC-32 of their key: a third,
the tuning rows, say how much likelier each bin and those above it are among
bad texts than among good ones; a text's score is the highest such log ratio
over the rules. The other two thirds, the holdout, certify cutoffs of the
score for each stratum: a cutoff may be used only if an exact binomial
(Clopper-Pearson) bound shows, at the corrected confidence, that it rejects at
most ``risk`` of the stratum's good texts that pass the base rules. Cutoffs
are tested from the highest on and testing ends at the first that fails (a
fixed sequence needs no correction); strata share ``error`` by Bonferroni. So
with probability 1 - ``error`` no stratum loses more than ``risk`` of these
texts. Among the certified cutoffs the one is taken that rejects most bad
texts, good ones counting ``good_weight`` times; if none is useful, none is
used.

A cutoff that rejects no good holdout text takes log(error / strata) /
log(1 - risk) of them: 217 for four strata. Strata with fewer than LEAST good
labelled rows, and all beyond the STRATA with most rows, are one stratum
together ("the rest", which the smallest other stratum joins where it is too small
itself), certified as such; so the driver and the plan hold a
bounded number of strata however many values the column has.

Nulls: a null text has no words and fails the base rules. A null stratum
belongs to the rest. Labels that are null are ignored; where a document has
several, the least counts. Empty tables give empty results. Repeated rows are
handled one by one; equal scores share their verdict.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import materialize

#: Share of a stratum's good texts that all rules together may reject, and the
#: probability that this fails anywhere.
RISK, ERROR = 0.02, 0.05
GOOD_WEIGHT = 20.0
#: Bins of a statistic's square root.
BINS = 50
#: Strata of their own at most, and the good labelled rows that it takes to be one.
STRATA, LEAST = 256, 350
WINDOW = 5
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = " \t\n\x0b\x0c\r"
RULES = ("symbols", "duplicate_lines", "repeats", "capitals")


def _without(text: Column, codes: str) -> Column:
    return F.length(F.translate(text, codes, "")).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of each text: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines (with a word), n_capitals (A-Z). Input columns of these
    names and of names that start with ``_m_`` are replaced.

    Repeats take no shuffle and O(n log n) steps: windows hash to 64 bits;
    only a text whose hashes aren't distinct sorts them with their places."""
    own = [c for c in docs.columns if c not in COUNTS and not c.startswith("_m_")]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = [F.col(c) for c in own]
    a = docs.select(*keep, body.alias("_m_text"))
    lines = F.filter(F.split(F.col("_m_text"), "\n", -1), lambda x: F.translate(x, _BLANK, "") != "")
    spaced = F.translate(F.col("_m_text"), _BLANK, " " * len(_BLANK))
    chars = _without(F.col("_m_text"), _BLANK)
    a = a.select(
        *keep,
        F.filter(F.split(spaced, " ", -1), lambda x: x != "").alias("_m_words"),
        lines.alias("_m_lines"),
        chars.alias("word_chars"),
        (F.length("_m_text") - _without(F.col("_m_text"), _SYMBOLS)).alias("n_symbols"),
        (F.length("_m_text") - _without(F.col("_m_text"), _UPPER)).alias("n_capitals"),
    )
    counts = ["word_chars", "n_symbols", "n_capitals"]
    words = F.col("_m_words")
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    hashes = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    a = a.select(
        *keep,
        *counts,
        F.size(words).cast("long").alias("n_words"),
        F.size("_m_lines").cast("long").alias("n_lines"),
        (F.size("_m_lines") - F.size(F.array_distinct("_m_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_m_hashes"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    repeated = F.size(F.array_distinct("_m_hashes")) < F.size("_m_hashes")
    placed = F.sort_array(F.transform("_m_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.select(*keep, *counts, F.when(repeated, placed).alias("_m_sorted"))
    same = F.zip_with("_m_sorted", F.slice("_m_sorted", 2, F.greatest(F.size("_m_sorted"), F.lit(1))), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    a = a.select(*keep, *counts, "_m_sorted", same.alias("_m_same"))
    twice = F.zip_with("_m_same", F.concat(F.array(F.lit(False)), F.col("_m_same")), lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)))
    starts = F.sort_array(F.filter(F.zip_with("_m_sorted", twice, lambda p, d: F.when(d, p["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("until")),
        lambda at, i: F.struct((at["sum"] + WINDOW - F.greatest(at["until"] - i, F.lit(0))).alias("sum"), (i + WINDOW).alias("until")),
        lambda at: at["sum"],
    )
    return a.select(*keep, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistic(rule: str) -> Column:
    """The rule's statistic, from 0 to 1 and higher for worse texts."""
    part, whole = {"symbols": ("n_symbols", "word_chars"), "duplicate_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}[rule]
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(at most k of n), summed exactly from the largest term down."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = min(k, int(n * p))
    total = 0.0
    for way in (range(top, -1, -1), range(top + 1, k + 1)):
        for i in way:
            term = math.exp(log(i))
            total += term
            if term < total * 1e-17:
                break
    return min(1.0, total)


def certified(rejected: int, good: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound of the rejection rate, at confidence
    1 - error, is at most ``risk``."""
    return good > 0 and binomial_cdf(rejected, good, risk) <= error


def likelihood(good: list[int], bad: list[int]) -> list[float]:
    """For each bin the log ratio of the shares of bad and of good texts that
    lie there or above, never falling, from counts by bin."""
    out, best = [], -math.inf
    for k in range(len(good)):
        share = lambda x: (sum(x[k:]) + 0.5) / (sum(x) + 1)
        best = max(best, math.log(share(bad) / share(good)))
        out.append(round(best, 6))
    return out


def choose(cells: list[tuple], risk: float = RISK, error: float = ERROR, good_weight: float = GOOD_WEIGHT) -> dict:
    """Cutoff by stratum, from holdout cells (stratum, score, label is good,
    rows): texts that score the cutoff or more are rejected."""
    strata = {c[0] for c in cells}
    out = {}
    for stratum in strata:
        own = [c for c in cells if c[0] == stratum]
        total = {is_good: sum(n for *_, g, n in own if g == is_good) for is_good in (True, False)}
        lost = {True: 0, False: 0}
        gain = 0.0
        for cutoff in sorted({c[1] for c in own if c[1] > 0}, reverse=True):
            for _, score, is_good, n in own:
                if score == cutoff:
                    lost[is_good] += n
            if not certified(lost[True], total[True], risk, error / len(strata)):
                break
            value = lost[False] / max(1, total[False]) - good_weight * lost[True] / total[True]
            if value > gain:
                gain, out[stratum] = value, cutoff
    return out


def bin_of(rule: str) -> Column:
    """The bin of a rule's statistic, 1 to BINS + 1."""
    return F.width_bucket(F.sqrt(statistic(rule)), F.lit(0.0), F.lit(1.0), F.lit(BINS)).cast("int")


class QualityRules:
    """tables: log ratios by stratum and rule; cutoffs: by stratum; REST stands
    for all strata that aren't named."""

    REST = "\x00rest"

    def __init__(self, spark: SparkSession, tables: dict[str, dict[str, list[float]]], cutoffs: dict[str, float]):
        self.spark, self.tables, self.cutoffs = spark, tables, cutoffs

    @classmethod
    def fit(cls, measured: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", label: str = "quality", risk: float = RISK, error: float = ERROR) -> QualityRules:
        """measured: what ``measure`` returned, with the key and the stratum."""
        spark = measured.sparkSession
        marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(label) == 1).alias("_good"))
        slim = measured.where(~base_failed()).select(F.col(key).alias("_own"), F.col(stratum).cast("string").alias("_stratum"), *[bin_of(r).alias(r) for r in RULES])
        tuning = (F.crc32(F.concat(F.lit("tune"), F.col("_key").cast("string")).cast("binary")) % 3 == 0).alias("_tuning")
        rows = materialize(spark, slim.join(marked, F.col("_own") == F.col("_key")).select("_stratum", "_good", tuning, *RULES), "labelled")
        known = rows.where("_good and _stratum is not null").groupBy("_stratum").count().where(F.col("count") >= LEAST)
        sizes = known.orderBy(F.desc("count"), "_stratum").limit(STRATA).collect()
        named = [r["_stratum"] for r in sizes]
        rest = rows.where("_good").count() - sum(r["count"] for r in sizes)
        while named and 0 < rest < LEAST:  # too few to certify anything: joined by the smallest other
            named.pop()
            rest += sizes[len(named)]["count"]
        rows = rows.withColumn("_stratum", cls._name(F.col("_stratum"), named))
        tune = rows.where("_tuning").select("_stratum", "_good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES])).alias("x"))
        tables: dict = {n: {r: {True: [0] * (BINS + 1), False: [0] * (BINS + 1)} for r in RULES} for n in (*named, cls.REST)}
        # At most strata x rules x bins x 2 rows, whatever the input.
        for r in tune.groupBy("_stratum", "x.rule", "x.bin", "_good").count().collect():
            tables[r["_stratum"]][r["rule"]][r["_good"]][r["bin"] - 1] += r["count"]
        tables = {n: {rule: likelihood(x[True], x[False]) for rule, x in own.items()} for n, own in tables.items()}
        rules = cls(spark, tables, {})
        cells = rules.scored(rows.where("not _tuning"), {r: F.col(r) for r in RULES}).groupBy("_stratum", "_score", "_good").count()
        # At most strata x rules x bins x 2 rows as well.
        rules.cutoffs = choose([tuple(r) for r in cells.collect()], risk, error)
        return rules

    @classmethod
    def _name(cls, stratum: Column, named: list[str]) -> Column:
        return F.coalesce(F.when(stratum.isin(named), stratum), F.lit(cls.REST)) if named else F.lit(cls.REST)

    def scored(self, rows: DataFrame, bins: dict[str, Column]) -> DataFrame:
        """``rows`` (with a named ``_stratum``) and their ``_score`` and ``_cutoff``.
        The table of strata has STRATA + 1 rows at most and is broadcast."""
        score = F.greatest(*[F.element_at(f"_t_{r}", bins[r]) for r in RULES])
        drop = [f"_t_{r}" for r in RULES]
        if len(self.tables) == 1:
            found = rows.withColumns({f"_t_{r}": F.lit(x) for r, x in self.tables[self.REST].items()} | {"_cutoff": F.lit(self.cutoffs.get(self.REST)).cast("double")})
            return found.withColumn("_score", score).drop(*drop)
        kind = f"_stratum:string,_cutoff:double,{','.join(f'_t_{r}:array<double>' for r in RULES)}"
        known = [{"_stratum": n, "_cutoff": self.cutoffs.get(n)} | {f"_t_{r}": x for r, x in own.items()} for n, own in self.tables.items()]
        table = self.spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(known)), f"array<struct<{kind}>>")))
        return rows.join(F.broadcast(table), "_stratum").withColumn("_score", score).drop(*drop)

    def verdicts(self, measured: DataFrame, stratum: str) -> DataFrame:
        """``measured`` with base_failed and kept (passes the base rules and
        scores below its stratum's cutoff)."""
        named = [n for n in self.tables if n != self.REST]
        own = measured.columns
        found = self.scored(measured.withColumn("_stratum", self._name(F.col(stratum), named)), {r: bin_of(r) for r in RULES})
        bad = base_failed() | F.coalesce(F.col("_score") >= F.col("_cutoff"), F.lit(False))
        return found.select(*[c for c in own if c not in ("base_failed", "kept", "_stratum")], base_failed().alias("base_failed"), (~bad).alias("kept"))


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Key, counts and verdicts (base_failed, kept) of every document; other
    columns are left out. Texts are read once: their counts go to a table in
    the shared folder."""
    slim = docs.select(F.col(key), F.col(stratum).cast("string").alias("_of"), F.col(text).alias("_text"))
    measured = materialize(spark, measure(slim, "_text").drop("_text"), "quality")
    return QualityRules.fit(measured, labels, "_of", key).verdicts(measured, "_of").drop("_of")

"""Entries to findings: one lazy plan without a shuffle.

One pass over each command's bytes (``functions/triggers.py``) tests all rules
and says which detectors can find something; commands without any go. Detection,
first-come selection, scoring and rule matches are arrays on the entry's row;
only then findings become rows. Entropies and masks come from Arrow functions,
which only rows that are left, or have findings, reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.detectors import candidates
from vigil.functions.redact import redact_command
from vigil.functions.score import first_by_token, scored, severity_name
from vigil.functions.text import entropies, first_place
from vigil.functions.triggers import FIRED, LIVE, seen
from vigil.operators import rules as R
from vigil.schema import RANK

FOUND = "array<struct<token:string,det_type:string,entropy:double,score:int,severity_rank:int>>"


def rule_findings(command: Column, found: Column, checks: Column, rules: list[tuple[str, str]]) -> Column:
    """A high finding for each matching rule, by its number in ``checks``, unless
    a detector's high finding has the very token."""
    if not rules:
        return F.array().cast(FOUND)
    high = F.transform(F.filter(found, lambda f: f["severity_rank"] == 3), lambda f: f["token"])
    table = R.constant(rules)
    hits = F.transform(checks, lambda n: F.get(table, n))
    tokens = F.filter(F.transform(hits, lambda r: R.rule_token(command, r["match_kind"], r["pattern"])), lambda t: ~F.array_contains(high, t))
    row = lambda t: F.struct(t.alias("token"), F.lit("config_check").alias("det_type"), F.lit(0.0).alias("entropy"), F.lit(7).alias("score"), F.lit(3).alias("severity_rank"))
    return F.when(F.size(checks) > 0, F.transform(tokens, row).cast(FOUND)).otherwise(F.array().cast(FOUND))


def _rules_of(rules: list[tuple] | None, deep: bool) -> tuple[list, list]:
    """(ignore rules, check rules)."""
    rules = R.default_rules() if rules is None else rules
    return R.of_kind(rules, "ignore", *(["deep_ignore"] if deep else [])), R.of_kind(rules, "check", *(["deep_check"] if deep else []))


def detected(
    entries: DataFrame, rules: list[tuple] | None = None, threshold: float = fixed.ENTROPY_THRESHOLD, deep: bool = False, registry=None, everything: bool = False
) -> DataFrame:
    """Those of ``entries`` that may hold findings, or with ``everything`` all,
    with the array ``_found`` of them. Detectors that aren't the built-in ones
    run on every command that no rule ignores."""
    ignore, check = _rules_of(rules, deep)
    command = F.col("command")
    own = entries.columns
    live = entries.withColumn("_seen", seen(command, ignore, check, getattr(rules, "stored", {}).get(deep))).select(*own, F.col("_seen.mask").alias("_mask"), F.col("_seen.checks").alias("_checks"))
    bits = F.lit(LIVE if registry else FIRED)
    if not everything:
        live = live.where(F.col("_mask").bitwiseAND(bits) != 0)
    # Each array is a column of its own: inside a lambda it would be worked out again for every element.
    live = live.select(*own, "_checks", candidates(command, registry, F.col("_mask")).alias("_candidates"))
    live = live.select(*own, "_checks", first_by_token(F.col("_candidates")).alias("_first"))
    live = live.withColumn("_bits", entropies(F.transform("_first", lambda c: c["token"])))
    live = live.select(*own, "_checks", scored(F.col("_first"), F.col("_bits"), threshold).cast(FOUND).alias("_scored"))
    return live.select(*own, F.concat("_scored", rule_findings(command, F.col("_scored"), F.col("_checks"), check)).alias("_found"))


def scan(entries: DataFrame, rules: list[tuple] | None = None, threshold: float = fixed.ENTROPY_THRESHOLD, deep: bool = False, registry=None, redact: bool = True) -> DataFrame:
    """Findings of ``entries`` (any columns, with command): the entry's columns
    and ord, det_type, token, entropy, score, severity_rank, severity,
    match_start, match_len, recommendation, and with ``redact`` redacted,
    redacted_start, redacted_len. Ignored severities are included, as they take
    part in masking; ``visible`` filters. Null commands have no findings. Rules
    are constants of the plan, however many a user's files hold."""
    command = F.col("command")
    own = entries.columns
    live = detected(entries, rules, threshold, deep, registry)
    # The outer form, as the plain one would let the optimizer push a test of the
    # array's size below the projections and work everything out many times over.
    rows = live.select(*own, F.transform("_found", lambda f: f["token"]).alias("_tokens"), F.posexplode_outer("_found").alias("ord", "_f"))
    rows = rows.where(F.col("ord").isNotNull()).select(*own, "_tokens", "ord", "_f.*")
    at = first_place(command, F.col("token"))
    there = (F.col("token") != "") & (at >= 0)
    rows = rows.withColumns(
        {
            "severity": severity_name(F.col("severity_rank")),
            "match_start": F.when(there, at).otherwise(0),
            "match_len": F.when(there, F.length("token")).otherwise(0),
            "recommendation": R.hint(F.col("det_type"), F.col("token")),
        }
    )
    if redact:
        rows = rows.withColumn("_r", redact_command(command, F.col("_tokens"), F.col("token")))
        rows = rows.withColumns({"redacted": F.col("_r.text"), "redacted_start": F.col("_r.start"), "redacted_len": F.col("_r.length")}).drop("_r")
    return rows.drop("_tokens")


def visible(findings: DataFrame, level: str = "low") -> DataFrame:
    """Findings of a severity or above; ignored ones never."""
    return findings.where((F.col("severity_rank") >= RANK[level]) & (F.col("severity_rank") > 0))


def match_rules(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each entry and matching rule of a table, with the rule's
    ord and the token grown around the pattern."""
    return R.match_table(entries, rules.select("match_kind", "pattern", F.col("ord").cast("long").alias("rule_ord")))


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row (high, medium, low, total) over visible findings."""
    count = lambda rank: F.count_if(F.col("severity_rank") == rank)
    return findings.agg(count(3).alias("high"), count(2).alias("medium"), count(1).alias("low"), F.count_if(F.col("severity_rank") > 0).alias("total"))

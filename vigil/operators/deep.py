"""Transcript pieces to distinct secrets per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.redact import redact_token
from vigil.functions.score import severity_name
from vigil.functions.text import single_line, window
from vigil.operators.rules import has_known_prefix
from vigil.operators.scan import scan, visible
from vigil.schema import DEFAULT_SOURCES

#: Types that are certain enough for the strict posture.
CERTAIN = ("known_token", "private_key", "ssh_key", "config_check")


def strict(det_type: Column, token: Column) -> Column:
    return det_type.isin(*CERTAIN) | has_known_prefix(token)


def format_for_path(path: Column) -> Column:
    """The transcript format that a path stands for."""

    def holds(part: str) -> Column:
        return F.contains(path, F.lit(part)) | F.contains(path, F.lit(part.replace("/", "\\")))

    lines = (
        F.when(holds("/.codex/history.jsonl"), "codex_history")
        .when(holds("/.codex/sessions/"), "codex_session")
        .when(holds("/.claude/history.jsonl"), "claude_history")
        .when(holds("/.claude/projects/"), "claude")
        .when(holds("/.gemini/tmp/"), "gemini_jsonl")
        .when(holds("/.copilot/session-state/"), "copilot")
        .otherwise("jsonl")
    )
    return (
        F.when(F.endswith(path, F.lit(".jsonl")), lines)
        .when(F.endswith(path, F.lit(".json")), F.when(holds("/.gemini/tmp/"), "gemini_json").otherwise("json"))
        .when(F.endswith(path, F.lit(".md")) | F.endswith(path, F.lit(".markdown")), "markdown")
        .otherwise("text")
    )


def malformed_unit(format_: Column) -> Column:
    return F.when(format_.isin("json", "gemini_json"), "JSON document(s)").when(format_.isin("markdown", "text"), "record(s)").otherwise("JSONL record(s)")


def event_source(kind: Column) -> Column:
    """The part of a transcript that an event type stands for."""
    begins = lambda p: F.startswith(kind, F.lit(p))
    has = lambda p: F.contains(kind, F.lit(p))
    return (
        F.when(begins("user.") | begins("prompt."), "user_input")
        .when(has("reason"), "reasoning")
        .when(begins("assistant."), "assistant")
        .when(begins("tool.") & (has("start") | has("request")), "tool_call")
        .when(begins("tool."), "tool_output")
        .otherwise("stored_context")
    )


def scanned_sources(pieces: DataFrame, all_content: bool = False) -> DataFrame:
    return pieces if all_content else pieces.where(F.col("source").isin(*DEFAULT_SOURCES))


def deep_findings(pieces: DataFrame, rules=None, level: str = "low", all_content: bool = False, thorough: bool = False) -> DataFrame:
    """Visible findings of pieces (file, line, piece_seq, source, text)."""
    entries = scanned_sources(pieces, all_content).withColumnRenamed("text", "command")
    found = visible(scan(entries, rules, deep=True), level)
    return found if thorough else found.where(strict(F.col("det_type"), F.col("token")))


def deep_groups(findings: DataFrame) -> DataFrame:
    """Distinct secrets of each file: (file, token masked, det_type, severity,
    severity_rank, count, source, context), from one partial aggregation. The
    type is that of the first row of the highest severity; source and context
    are the first row's. Findings without a place go by their masked command."""
    placed = F.col("match_len") > 0
    order = F.struct("line", "piece_seq", "ord")
    context = single_line(window(F.col("redacted"), F.col("redacted_start"), F.col("redacted_len"), 120, 40))
    rows = findings.select(
        "file",
        F.when(placed, F.col("token")).otherwise(F.col("redacted")).alias("_key"),
        F.when(placed, redact_token(F.col("token"))).otherwise("****").alias("masked"),
        "det_type", "severity_rank", "source", context.alias("context"), order.alias("at"), F.struct(-F.col("severity_rank"), order).alias("rank"),
    )
    groups = rows.groupBy("file", "_key").agg(
        F.min_by("masked", "at").alias("token"),
        F.min_by("det_type", "rank").alias("det_type"),
        F.max("severity_rank").alias("severity_rank"),
        F.count("*").alias("count"),
        F.min_by("source", "at").alias("source"),
        F.min_by("context", "at").alias("context"),
        F.min("at").alias("first"),
    )
    return groups.withColumn("severity", severity_name(F.col("severity_rank"))).drop("_key")


def ordered(groups: DataFrame) -> DataFrame:
    """By file, severest and most frequent first, then by first appearance."""
    return groups.orderBy("file", F.col("severity_rank").desc(), F.col("count").desc(), "first")


def totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("secrets"), F.count_distinct("file").alias("files"))


def root_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (path) with the longest root (root, root_ord) they lie under; the
    first root wins a tie. Each path is joined with its own ancestors, so the
    join has a key however many roots there are."""
    parts = F.split("path", "/", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = files.select("path", F.explode(ancestors).alias("root"))
    joined = tried.join(roots.select("root", "root_ord"), "root")
    best = joined.groupBy("path").agg(F.min_by(F.struct("root", "root_ord"), F.struct(-F.length("root"), F.col("root_ord"))).alias("_b"))
    return best.select("path", "_b.root", "_b.root_ord")


def outside(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files (path) that are no excluded root (root) and lie under none."""
    parts = F.split("path", "/", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    gone = files.select("path", F.explode(ancestors).alias("root")).join(excluded.select("root"), "root", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")

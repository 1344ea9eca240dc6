"""Reports of findings: lines made by expressions, printed by the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import window

BADGES = {3: "[!!!]", 2: "[!! ]", 1: "[!  ]", 0: "[   ]"}
PROMPT_HISTORIES = ("/.codex/history.jsonl", "/.claude/history.jsonl", "/.ollama/history", "/.aider.input.history")
ORDER = ("source_ord", "file_ord", "file", "line", "entry_seq", "ord")


def in_order(findings: DataFrame) -> DataFrame:
    """By source, file, line and place within the entry."""
    return findings.orderBy(*[c for c in ORDER if c in findings.columns])


def badge(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == k, v) for k, v in BADGES.items()])


def _shown(redacted: bool) -> tuple[Column, Column, Column]:
    names = ("redacted", "redacted_start", "redacted_len") if redacted else ("command", "match_start", "match_len")
    return tuple(map(F.col, names))


def snippet(redacted: bool = True) -> Column:
    return window(*_shown(redacted), 160, 60)


def json_lines(findings: DataFrame, redacted: bool = True) -> DataFrame:
    """One JSON object a finding, in column value; null fields are kept."""
    fields = F.struct(
        "severity", "file", "line", F.col("ts").alias("timestamp"), "det_type", _shown(redacted)[0].alias("command"), "score", "recommendation"
    )
    return findings.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def short_lines(findings: DataFrame, redacted: bool = True) -> DataFrame:
    source = F.when(F.col("file") == "<env>", "ENV   ").when(F.col("file") == "<stdin>", "STDIN").otherwise("HIST  ")
    return findings.select(F.concat_ws(" ", badge(F.col("severity_rank")), source, snippet(redacted)).alias("value"))


def long_lines(findings: DataFrame, redacted: bool = True) -> DataFrame:
    value = F.concat(
        badge(F.col("severity_rank")), F.lit(" "), snippet(redacted), F.lit("\n      "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" ["), "det_type",
        F.lit("]\n      "), "recommendation", F.lit("\n"),
    )
    return findings.select(value.alias("value"))


def group_json_lines(groups: DataFrame) -> DataFrame:
    fields = F.struct("file", "token", "det_type", "severity", "count", "source", "context")
    return groups.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def group_lines(groups: DataFrame) -> DataFrame:
    text = F.concat(F.lit("  "), badge(F.col("severity_rank")), F.lit(" "), "det_type", F.lit("  "), "token", F.lit("  ("), F.col("count").cast("string"), F.lit("\u00d7, "), "source", F.lit(")\n        "), "context")
    return groups.select("file", text.alias("value"))


def deep_report(groups: DataFrame, out) -> tuple[int, int]:
    """Print groups under their files, which come in order, and the totals;
    (groups, files)."""
    total = files = 0
    last = None
    for row in group_lines(groups).toLocalIterator():
        if row["file"] != last:
            print(*([""] if files else []), row["file"], sep="\n", file=out)
            last, files = row["file"], files + 1
        print(row["value"], file=out)
        total += 1
    if total:
        print("", f"{total} secret(s) across {files} session file(s).", "Rotate the credentials, delete those files, and see that their folder isn't synced, committed or open to others.", sep="\n", file=out)
    else:
        print("No secrets found in agent transcripts.", file=out)
    return total, files


def root_counts(groups: DataFrame, files: list[tuple[str, int]], roots: list[str], home: str) -> list[str]:
    """One line a root: its files and the secrets in them."""
    at = groups.sparkSession.createDataFrame(files or [("", -1)], "file string, root int")
    found = {r["root"]: r["n"] for r in groups.select("file").join(at, "file").groupBy("root").agg(F.count("*").alias("n")).collect()}
    compact = lambda p: "~" + p[len(home) :] if home and (p + "/").startswith(home.rstrip("/") + "/") else p
    return [f"{compact(root)}: {sum(k == i for _, k in files)} file(s), {found.get(i, 0)} secret(s)" for i, root in enumerate(roots)]


def printed(lines: DataFrame) -> Iterator[str]:
    """Lines one partition at a time; the driver holds no more than one."""
    for row in lines.select("value").toLocalIterator():
        yield row["value"]


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files of a new folder, in the order they have: ranges of it
    by file name. Spark's writers commit whole files, so neither a killed task
    nor a failed job leaves half a file, and nothing passes through the driver."""
    lines.select("value").write.mode("errorifexists").text(path)


def summary(high: int, medium: int, low: int) -> str:
    total = high + medium + low
    if not total:
        return "No findings detected."
    return f"{total} finding(s) detected ({high} high, {medium} medium, {low} low).\nRemove flagged history entries and rotate affected credentials."


def from_prompt_history(file: Column) -> Column:
    ends = [e for p in PROMPT_HISTORIES for e in (p, p.replace("/", "\\"))]
    return reduce(or_, [F.endswith(file, F.lit(e)) for e in ends])


def needs_transcript_warning(findings: DataFrame) -> bool:
    return bool(findings.agg(F.bool_or(from_prompt_history(F.col("file")))).first()[0])


TRANSCRIPT_WARNING = "Warning: secrets in an agent's prompt history may also be in its session files; scan those with the deep command."
EXIT_CLEAN, EXIT_FOUND, EXIT_ERROR = 0, 1, 2

"""Scanning streams: the same plan, row by row, under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.scan import detected, scan, visible
from vigil.schema import RANK
from vigil.session import new_path


def stream_findings(entries: DataFrame, rules=None, level: str = "low", **options) -> DataFrame:
    """Visible findings of a stream of entries; stateless, so it appends."""
    return visible(scan(entries, rules, **options), level)


def run_available(spark: SparkSession, findings: DataFrame, path: str | None = None) -> DataFrame:
    """Run a stream over all there is now, into Parquet files (exactly once, by
    the checkpoint beside them), and return the files as a table."""
    path = path or new_path(spark, "stream")
    query = findings.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(findings.schema).parquet(f"{path}/data")


def gate(commands: DataFrame, rules=None, allow: str = "# allow", deny: str = "# deny", level: str = "medium") -> DataFrame:
    """``commands`` (key, command) with column allowed: a command that ends with
    one of the marks is let in or kept out by it, any other if nothing of
    ``level`` or above is found in it."""
    command = F.col("command")
    marked = F.when(F.endswith(command, F.lit(allow)), True).when(F.endswith(command, F.lit(deny)), False)
    rows = commands.select("key", "command")
    found = F.exists("_found", lambda f: f["severity_rank"] >= max(RANK[level], 1))
    judged = detected(rows, rules, everything=True)
    return judged.select("key", "command", F.coalesce(marked, ~found, F.lit(True)).alias("allowed"))


def gate_stream(commands: DataFrame, sink: Callable[[DataFrame], None], **options):
    """Gate each micro-batch of a stream of (key, command)."""
    return commands.writeStream.foreachBatch(lambda batch, _: sink(gate(batch, **options)))


def findings_per_hour(findings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour and severity with a watermark (column ts in seconds)."""
    timed = findings.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour"), "severity").count()


def deep_stream(findings: DataFrame) -> DataFrame:
    """Running counts and highest severity of each (file, token), in update
    mode. State grows with the distinct secrets: for bounded backfills."""
    return findings.groupBy("file", "token").agg(F.count("*").alias("count"), F.max("severity_rank").alias("severity_rank"))

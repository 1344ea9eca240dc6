"""Texts to physical lines and history entries, on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENDED = r"^: ([+-]?[0-9]+):[^;]*;((?s).+)$"
#: Line numbers that one window takes in, so that a long file spreads over tasks.
BLOCK = 1 << 16


def block_of(line: str) -> Column:
    return F.floor(F.col(line).cast("long") / F.lit(BLOCK))


def running_max(rows: DataFrame, value: Column, out: str, file: str) -> DataFrame:
    """``rows`` with the greatest ``value`` down to each line of its file: within
    its block, or else from the blocks above, which are one row each."""
    rows = rows.withColumns({"_block": block_of("line"), "_value": value})
    above = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(file, "_block").agg(F.max("_value").alias("_carried"))
    blocks = blocks.select(file, "_block", F.max("_carried").over(above).alias("_carried"))
    within = Window.partitionBy(file, "_block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(blocks, [file, "_block"]).withColumn(out, F.greatest(F.max("_value").over(within), "_carried")).drop("_block", "_value", "_carried")


def physical_lines(df: DataFrame, text: str = "text", out: str = "raw") -> DataFrame:
    """One row for each line feed-separated line: the other columns, line (from
    1) and the line itself. Empty lines are kept, for numbering."""
    keep = [c for c in df.columns if c != text]
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_at", out))
    return lines.select(*keep, (F.col("_at") + 1).cast("long").alias("line"), out)


def without_return(line) -> Column:
    """One trailing carriage return taken off."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def shell_entries(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries of plain and extended shell histories: ts and command beside
    each non-empty line; ``: <int>:<any>;<command>`` gives a time."""
    line = without_return(F.col(raw))
    extended = line.rlike(EXTENDED)
    ts = F.expr("try_cast(regexp_extract(_line, '^: ([+-]?[0-9]+):', 1) AS BIGINT)")
    fit = F.col("_extended") & F.col("_ts").isNotNull()
    return (
        lines.withColumn("_line", line)
        .where(F.col("_line") != "")
        .withColumns({"_extended": extended, "_ts": ts})
        .withColumns({"ts": F.when(fit, F.col("_ts")), "command": F.when(fit, F.regexp_extract("_line", EXTENDED, 2)).otherwise(F.col("_line"))})
        .drop("_line", "_extended", "_ts")
    )


def fish_entries(lines: DataFrame, file: str = "file", raw: str = "raw") -> DataFrame:
    """Entries of fish histories: (file, line, ts, command) from lines. A line
    ``- cmd: `` opens an entry; the last readable ``  when: `` below it counts."""
    line = without_return(F.col(raw))
    opens = F.startswith(line, F.lit("- cmd: "))
    when = F.when(F.startswith(line, F.lit("  when: ")), line)
    # Lines that open nothing and date nothing drop out before the shuffle.
    slim = lines.select(file, "line", opens.alias("opens"), F.when(opens, F.substring(line, F.lit(8), F.length(line))).alias("command"), when.alias("when"))
    slim = slim.where(F.col("opens") | F.col("when").isNotNull())
    numbered = running_max(slim, F.when(F.col("opens"), F.col("line")), "island", file).where("island IS NOT NULL")
    stamp = F.expr("CASE WHEN when RLIKE '^  when: [+-]?[0-9]+$' THEN try_cast(substring(when, 9) AS BIGINT) END")
    numbered = numbered.withColumn("stamp", F.struct("line", stamp.alias("ts")))
    found = numbered.groupBy(file, "island").agg(
        F.max_by("stamp", F.when(F.col("when").isNotNull(), F.col("line"))).getField("ts").alias("ts"),
        F.max("command").alias("command"),
    )
    return found.select(file, F.col("island").alias("line"), "ts", "command")


def text_pieces(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines of plain and Markdown texts, all trailing carriage returns off."""
    return lines.withColumn(raw, F.rtrim(F.col(raw), F.lit("\r"))).where(F.col(raw) != "")


def oversized(raw, limit: int) -> Column:
    return F.octet_length(raw) >= limit

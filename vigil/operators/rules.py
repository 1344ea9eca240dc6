"""Rules and hints as data: parsing, compiling, storing, matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.automaton import matching_any, rule_blocks
from vigil.functions.literals import Literals
from vigil.functions.text import table
from vigil.schema import HINT, RULE
from vigil.session import materialize, new_path, ship_package

#: Groups in the order in which they are compiled.
KINDS = ("ignore", "check", "path", "deep_ignore", "deep_check", "deep_path")
MATCH_KINDS = {"exact:": "exact", "prefix:": "prefix", "substr:": "substring"}
#: Up to this many rules are a branch of the plan each; more are automata.
FOLDED = 32
#: Bytes of the patterns and hashes that one pass over the texts looks for; further rules take further passes.
PASS_CELLS = 64 << 20
_TRIM = " \t\r\n"


def parse_rule(line: str, kind: str) -> tuple[str, str, str] | None:
    """(kind, match_kind, pattern) of a rule line; None for blanks, comments
    and empty patterns. Path rules keep the whole trimmed line."""
    line = line.strip(_TRIM)
    if not line or line.startswith("#"):
        return None
    if kind.endswith("path"):
        return kind, "exact", line
    for prefix, match_kind in MATCH_KINDS.items():
        if line.startswith(prefix):
            return (kind, match_kind, line[len(prefix) :]) if line[len(prefix) :] else None
    return kind, "substring", line


def compile_rules(groups: dict[str, list[str]]) -> list[tuple[str, str, str, int]]:
    """Rows of the rule table from the lines of each kind, in fixed order."""
    found = [r for kind in KINDS for line in groups.get(kind, ()) if (r := parse_rule(line, kind))]
    return [(*r, i) for i, r in enumerate(found)]


def default_rules() -> list[tuple[str, str, str, int]]:
    return compile_rules({"ignore": list(fixed.IGNORE_RULES), "check": list(fixed.MATCH_RULES), "path": list(fixed.HISTORY_PATHS), "deep_path": list(fixed.TRANSCRIPT_PATHS)})


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def save_rules(spark: SparkSession, rules: list[tuple[str, str, str, int]], path: str) -> None:
    rule_table(spark, rules).coalesce(1).write.mode("overwrite").parquet(path)


def load_rules(spark: SparkSession, path: str) -> list[tuple[str, str, str, int]]:
    """Rules of a table, in order; a table that doesn't hold rules is an error."""
    table = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in table.schema] != [(f.name, f.dataType) for f in RULE]:
        raise ValueError(f"{path} is no rule table")
    rows = sorted((tuple(r) for r in table.collect()), key=lambda r: r[3])  # rules are written by people
    for kind, match_kind, pattern, _ in rows:
        if kind not in KINDS or match_kind not in MATCH_KINDS.values() or not pattern:
            raise ValueError(f"{path} holds a rule that isn't valid")
    return rows


def of_kind(rules: list[tuple], *kinds: str) -> list[tuple[str, str]]:
    """(match_kind, pattern) of the rules of some kinds, in order."""
    return [(m, p) for k, m, p, _ in rules if k in kinds]


def matches(text: Column, match_kind: str, pattern: str) -> Column:
    literal = F.lit(pattern)
    return {"exact": text == literal, "prefix": F.startswith(text, literal), "substring": F.contains(text, literal)}[match_kind]


def constant(rules: list[tuple[str, str]]) -> Column:
    """Rules as one constant array of structs (match_kind, pattern)."""
    return table([{"match_kind": m, "pattern": p} for m, p in rules], "match_kind:string,pattern:string")


def _walked(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether any rule matches, by automata."""
    spark = SparkSession.active()
    ship_package(spark)
    blocks = spark.sparkContext.broadcast(list(rule_blocks(rules)))
    return F.arrow_udf(lambda t: matching_any(t, blocks.value), "boolean")(text)


def matches_any(text: Column, rules: list[tuple[str, str]]) -> Column:
    if len(rules) > FOLDED:
        return _walked(text, rules)
    return reduce(lambda a, b: a | b, [matches(text, m, p) for m, p in rules], F.lit(False))


def _usable(rules: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rules without null, those of whole texts apart."""
    usable = rules.where("match_kind IS NOT NULL AND pattern IS NOT NULL").select("match_kind", "pattern", *columns)
    return usable.where("match_kind = 'exact'"), usable.where("match_kind <> 'exact'")


def _passes(rules: DataFrame, kept: bool) -> Iterator[pa.Table]:
    """Distinct patterns of a rule table, with ``kept`` also the numbers of the
    rules that have them, in parts that one pass over the texts can look for.
    Only what differs counts: rules that repeat a pattern need no further pass."""
    found = rules.groupBy("match_kind", "pattern").agg(F.sort_array(F.collect_list("rule_ord")).alias("rule_ords") if kept else F.count("*").alias("n"))
    own = F.octet_length("pattern") + 32 + (8 * F.size("rule_ords") if kept else 0)
    weight, wrong = found.agg(F.sum(own), F.min(F.when(~F.col("match_kind").isin("prefix", "substring"), F.col("match_kind")))).first()
    if wrong is not None:
        raise ValueError(f"{wrong} is no kind of rule")
    parts = -(-(weight or 0) // PASS_CELLS)
    if parts > 1:  # written once, so that a part reads its own rows only
        path, found = new_path(rules.sparkSession, "patterns"), found.withColumn("part", F.pmod(F.xxhash64("match_kind", "pattern"), F.lit(parts)))
        found.write.partitionBy("part").parquet(path)
        found = rules.sparkSession.read.schema(found.schema).parquet(path)
    for n in range(parts):
        part = (found.where(F.col("part") == n).drop("part") if parts > 1 else found).toArrow()
        if part.num_rows:
            yield part


def _sent(spark: SparkSession, part: pa.Table, kept: bool):
    """The part's literals, with ``kept`` also its rows, on all executors."""
    ship_package(spark)
    part = part.combine_chunks()
    literals = Literals(*(pa.concat_arrays(part[c].chunks) for c in ("match_kind", "pattern")))
    return spark.sparkContext.broadcast((literals, part if kept else None))


def _hit(text: Column, part: pa.Table) -> Column:
    """Whether any pattern of the part occurs. As a plain function it would be
    pushed below the shuffle that deals the texts, into the few tasks that read
    the table."""
    sent = _sent(SparkSession.active(), part, False)
    return F.arrow_udf(lambda texts: pa.array(sent.value[0].hitting(texts)), "boolean").asNondeterministic()(text)


def anti_match(entries: DataFrame, rules: DataFrame, text: str = "command") -> DataFrame:
    """Entries that no rule of the table matches; null texts stay. Rules of
    whole texts are joined. The others' patterns are broadcast, each once, and
    looked for by their hashes until a text has one; where they are too many for
    one pass, what is left goes through the next."""
    spark = entries.sparkSession
    whole, parts = _usable(rules)
    for n, part in enumerate(_passes(parts, False)):
        if n:
            entries = materialize(spark, entries, "unmatched")
        entries = entries.where(~_hit(F.col(text), part))
    return entries.join(whole.select(F.col("pattern").alias("_whole")).distinct(), F.col(text) == F.col("_whole"), "left_anti")


_HITS = "array<struct<match_kind:string,pattern:string,rule_ords:array<long>>>"


def _rows_hit(text: Column, part: pa.Table) -> Column:
    """The patterns of the part that occur, with the numbers of their rules."""
    sent = _sent(SparkSession.active(), part, True)

    def hits(texts: pa.Array) -> pa.Array:
        literals, table = sent.value
        found = list(literals.matching(texts))
        text, rule = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))
        rows = table.take(pa.array(rule)).combine_chunks().to_struct_array()
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], rows.type)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)), rows)

    return F.arrow_udf(hits, _HITS).asNondeterministic()(text)


def match_table(entries: DataFrame, rules: DataFrame, text: str = "command") -> DataFrame:
    """Each entry with each rule (match_kind, pattern, rule_ord) that it
    matches, and the ``token`` grown around the pattern."""
    own = entries.columns
    whole, parts = _usable(rules, "rule_ord")
    whole = whole.select(F.col("match_kind").alias("_kind"), F.col("pattern").alias("_whole"), F.col("rule_ord").alias("_ord"))
    joined = entries.join(whole, F.col(text) == F.col("_whole"))
    found = joined.select(*own, F.col("_kind").alias("match_kind"), F.col("_whole").alias("pattern"), F.col("_ord").alias("rule_ord"), rule_token(F.col(text), F.col("_kind"), F.col("_whole")).alias("token"))
    for part in _passes(parts, True):
        each = entries.withColumn("_hits", _rows_hit(F.col(text), part)).select(*own, F.inline("_hits"))
        # A pattern's token is made once for all rules that have it.
        each = each.withColumn("token", rule_token(F.col(text), F.col("match_kind"), F.col("pattern")))
        found = found.unionByName(each.withColumn("rule_ord", F.explode("rule_ords")).drop("rule_ords"))
    return found


_TOKEN = r"^[A-Za-z0-9._/\-]*"


def grown_token(text: Column, pattern: Column, at: Column) -> Column:
    """The pattern at place ``at`` (1-based), grown both ways over token characters."""
    lead = F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), at - 1)), _TOKEN, 0))
    trail = F.regexp_extract(F.substring(text, at + F.length(pattern), F.length(text)), _TOKEN, 0)
    return F.concat(lead, pattern, trail)


def rule_token(text: Column, match_kind: Column, pattern: Column) -> Column:
    return grown_token(text, pattern, F.when(match_kind == "substring", F.position(pattern, text)).otherwise(1))


# --- hints ---


def hint_rows() -> list[tuple[str, str, str, int]]:
    rows = [("prefix", k, h) for k, h in fixed.PREFIX_HINTS] + [("det_type", k, h) for k, h in fixed.TYPE_HINTS]
    return [(*r, i) for i, r in enumerate(rows)]


def hint_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(hint_rows(), HINT)


def hint(det_type: Column, token: Column) -> Column:
    """The hint of the longest prefix, or of the type, or the default."""
    longest = table([{"prefix": p, "hint": h} for p, h in sorted(fixed.PREFIX_HINTS, key=lambda x: -len(x[0]))], "prefix:string,hint:string")
    by_prefix = F.get(F.filter(longest, lambda x: F.startswith(token, x["prefix"])), 0)["hint"]
    by_type = [F.when(det_type == k, F.lit(h)) for k, h in fixed.TYPE_HINTS]
    return F.coalesce(by_prefix, *by_type, F.lit(fixed.DEFAULT_HINT))


def has_known_prefix(token: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(token, F.lit(p)) for p, _ in fixed.PREFIX_HINTS])

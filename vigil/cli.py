"""Command line: scan, history, env, deep (agents), fix, config and version."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from vigil import __version__, config, sinks
from vigil.functions import rulefile
from vigil.functions.fixed import ENTROPY_THRESHOLD
from vigil.operators import deep, fix, lines
from vigil.operators.rules import of_kind
from vigil.operators.scan import scan, severity_counts, visible
from vigil.schema import SEVERITIES
from vigil.session import materialize
from vigil.sources import discover, files, parsers


def _bool(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def _switch(p: argparse.ArgumentParser, name: str, default: bool = False, *short: str) -> None:
    """--name, --name=true or --name=false."""
    p.add_argument(f"--{name}", *short, nargs="?", const=True, default=default, type=_bool)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vigil")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *switches: str, path: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if path:
            p.add_argument("--path", "-p", action="append", default=[])
        p.add_argument("--level", choices=SEVERITIES[1:], default="high")
        for s in switches:
            _switch(p, s)
        return p

    for name in ("scan", "history", "env"):
        p = command(name, "json", "one-line", "summary", path=name != "env")
        p.add_argument("--out", help="a new folder for the JSON lines, which Spark's tasks write")
        p.add_argument("--entropy-threshold", "--entropy", dest="entropy", type=float, default=ENTROPY_THRESHOLD)
        _switch(p, "redacted", True)
        p.add_argument("--no-redact", dest="redacted", action="store_false")
        if name != "env":
            _switch(p, "stdin")
        if name == "scan":
            _switch(p, "env", True)
            _switch(p, "hist", True)
    for name in ("deep", "agents"):
        p = command(name, "json", "all-content", "thorough", "counts")
        p.add_argument("--out", help="a new folder for the JSON lines, which Spark's tasks write")
    p = command("fix", "dry-run", "redacted")
    p.add_argument("--redact", dest="redacted", action="store_true")
    _switch(p, "yes", False, "-y")
    sub.add_parser("version")
    p = sub.add_parser("config")
    p.add_argument("action", choices=("init", "defaults", "status", "ignore", "check", "discover", "compile"))
    p.add_argument("pattern", nargs="?", help="a pattern; for compile the file to write")
    p.add_argument("--remove", action="store_true")
    p.add_argument("--yes", "-y", action="store_true", help="for discover and defaults: don't ask")
    return top


def _entries(spark, args, rules, env):
    """Standard input, then histories, then the environment."""
    parts = []
    if getattr(args, "stdin", False):
        parts.append(files.stream_text(spark, sys.stdin.buffer.read()))
    if args.command == "history" or args.command == "scan" and (args.hist or args.path):
        paths = discover.explicit(args.path, env) if args.path else discover.histories([p for _, p in of_kind(rules, "path")], env)
        parts.append(files.read_histories(spark, paths))
    if args.command == "env" or args.command == "scan" and args.env and not args.path:
        parts.append(files.environment(spark, env))
    parts = parts or [files.environment(spark, {})]
    out = parts[0].withColumn("source_ord", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("source_ord", F.lit(i)))
    return out


def run_scan(spark, args, rules, env, out) -> int:
    # Files are read and searched once: what was skipped is counted on the way,
    # and every report below reads the findings.
    told = Observation("read")
    trouble = F.when(F.col("error") != "oversized", F.concat_ws(": ", "file", "error"))
    entries = _entries(spark, args, rules, env).observe(told, F.count_if(F.col("error") == "oversized").alias("skipped"), F.collect_set(trouble).alias("unread"))
    found = materialize(spark, visible(scan(entries, rules, args.entropy), args.level), "findings")
    if told.get["skipped"]:
        print(f"{told.get['skipped']} line(s) too long, skipped", file=sys.stderr)
    for line in sorted(told.get["unread"]):  # one for each file that couldn't be read
        print(f"cannot read {line}", file=sys.stderr)
    counts = severity_counts(found).first()
    if args.out:
        sinks.write_lines(sinks.json_lines(sinks.in_order(found), args.redacted), args.out)
    elif not args.summary:
        make = sinks.json_lines if args.json else sinks.short_lines if args.one_line else sinks.long_lines
        for line in sinks.printed(make(sinks.in_order(found), args.redacted)):
            print(line, file=out)
    if args.one_line:
        print(counts.high, counts.medium, counts.low, file=out)
    elif not args.json:
        print(sinks.summary(counts.high, counts.medium, counts.low), file=out)
    if counts.total and not args.json and sinks.needs_transcript_warning(found):
        print(sinks.TRANSCRIPT_WARNING, file=out)
    return sinks.EXIT_FOUND if counts.total else sinks.EXIT_CLEAN


def run_deep(spark, args, rules, env, out) -> int:
    roots = args.path or [p for _, p in of_kind(rules, "deep_path")]
    known = discover.transcripts(roots, env, strict=bool(args.path))
    pieces = materialize(spark, files.read_transcripts(spark, [f for f, _ in known]), "pieces")
    malformed = pieces.groupBy("file").agg(F.sum("malformed").alias("n")).where("n > 0").collect()
    texts = pieces.where(F.col("text").isNotNull()).select("file", "line", "piece_seq", "source", "text")
    groups = materialize(spark, deep.deep_groups(deep.deep_findings(texts, rules, args.level, args.all_content, args.thorough)), "groups")
    if args.out:
        count = groups.count()
        sinks.write_lines(sinks.group_json_lines(deep.ordered(groups)), args.out)
    elif args.json:
        count = 0
        for line in sinks.printed(sinks.group_json_lines(deep.ordered(groups))):
            count += 1
            print(line, file=out)
    else:
        count, _ = sinks.deep_report(deep.ordered(groups), out)
    if args.counts:
        named = [discover.expand(r, env) for r in roots if not r.startswith("!")]
        print(*sinks.root_counts(groups, known, named, env.get("HOME") or env.get("USERPROFILE") or ""), sep="\n", file=sys.stderr)
    for row in malformed:  # one row a damaged file
        print(f"{row['file']}: {row['n']} malformed record(s)", file=sys.stderr)
    return sinks.EXIT_ERROR if malformed else sinks.EXIT_FOUND if count else sinks.EXIT_CLEAN


def _confirmed(path: str, line: int, full: str, redacted: str, args, out) -> str:
    """y, n or q. On a terminal an entry shown in full is masked once decided."""
    shown = redacted if args.redacted else full
    print(f"{path}:{line} {shown}", file=out)
    if args.yes or args.dry_run:
        return "y" if args.yes and not args.dry_run else "n"
    try:
        answer = input("Remove this entry? [y/N/q] ").strip().lower()
    except EOFError:
        answer = ""
    decision = {"y": "y", "yes": "y", "q": "q", "quit": "q"}.get(answer, "n")
    if out.isatty() and not args.redacted:
        told = {"y": "removed", "n": "kept", "q": "quit"}[decision]
        print(f"\x1b[2A\r\x1b[2K{path}:{line} {redacted}  \u2192 {told}\x1b[2B\r", end="", file=out)
    return decision


def _fixable(spark, path: str, snapshot) -> tuple:
    """(entries, spans) of a history. Lines that scans skip can't be removed either."""
    rows = spark.createDataFrame([(path, snapshot.data.decode("utf-8", "replace"))], "file string, text string")
    physical = lines.physical_lines(rows)
    spans = fix.fish_spans(physical) if parsers.history_kind(path) == "fish" else fix.shell_spans(physical)
    return files.history_text(spark, path, snapshot.data).where(F.col("command").isNotNull()), spans


def run_fix(spark, args, rules, env, out) -> int:
    paths = discover.explicit(args.path, env) if args.path else discover.histories([p for _, p in of_kind(rules, "path")], env)
    total = files_with = 0
    for path in paths:  # each file is rewritten on its own
        try:
            snapshot = fix.Snapshot.take(path)
        except OSError as error:
            print(f"{path}: {error.strerror}, skipped", file=sys.stderr)
            continue
        entries, spans = _fixable(spark, path, snapshot)
        found = visible(scan(entries, rules), args.level)
        removed, answer, own = [], "n", 0
        for c in fix.removal_candidates(found, spans).orderBy("span_start").toLocalIterator():
            own += 1
            answer = _confirmed(path, c["span_start"], sinks_text(c["full"]), sinks_text(c["redacted"]), args, out)
            if answer == "q":
                break
            if answer == "y":
                removed.append((c["span_start"], c["span_end"]))
        total, files_with = total + own, files_with + bool(own)
        if removed:
            fix.rewrite(snapshot, fix.without_lines(snapshot.data, removed))
            print(f"Removed {_entries_of(len(removed))} from {path}.", file=out)
        if answer == "q":
            break
    if not total:
        print("No secrets found in history files.", file=out)
    elif args.dry_run:
        print(f"\n{_entries_of(total)} would be removed across {files_with} file(s).", file=out)
    return sinks.EXIT_FOUND if total else sinks.EXIT_CLEAN


def _entries_of(n: int) -> str:
    return f"{n} entry" if n == 1 else f"{n} entries"


def sinks_text(text: str) -> str:
    return text.translate(str.maketrans("\n\r\t", "   "))


def run_config(args, env, out, spark=None) -> int:
    folder = config.user_folder(env)
    if args.action == "defaults":
        agreed = lambda path: args.yes or _agreed(f"{path} exists. Overwrite it?")
        print(*[f"wrote {p}" for p in config.init(folder, agreed)], sep="\n", file=out)
    elif args.action in ("init", "compile"):
        if args.action == "init":
            print(*[f"wrote {p}" for p in config.init(folder)], sep="\n", file=out)
        target = args.action == "compile" and args.pattern or config.compiled(folder)
        rules = rulefile.write(target, config.read_rules(config.system_folder(env), folder))
        print(f"{len(rules)} rule(s) in {target}", file=out)
    elif args.action in ("ignore", "check"):
        if not args.pattern or not config.edit(folder, args.action, args.pattern, args.remove):
            return sinks.EXIT_ERROR
        print("Run config compile to apply changes.", file=out)
    elif args.action == "discover":
        for path in config.discover(folder, env, config.read_rules(config.system_folder(env), folder)):
            agreed = args.yes or _agreed(f"Add {path}?")
            print(path + ("  \u2192 added" if agreed and config.edit(folder, "path", path) else ""), file=out)
    else:
        print(*config.status(config.read_rules(config.system_folder(env), folder)), sep="\n", file=out)
    return sinks.EXIT_CLEAN


def _agreed(question: str) -> bool:
    if not sys.stdin.isatty():
        return False
    return input(f"{question} [y/N] ").strip().lower() in ("y", "yes")


def _session():
    from vigil.session import local_session

    return local_session("*")


def main(argv: list[str] | None = None, spark=None, env: dict[str, str] | None = None, out=None) -> int:
    """0: clean, 1: something was found, 2: error."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0].startswith("-") and argv[0] not in ("-h", "--help"):
        argv.insert(0, "scan")  # flags alone scan
    args, env, out = parser().parse_args(["--help"] if argv == ["help"] else argv), dict(os.environ if env is None else env), out or sys.stdout
    try:
        if args.command == "version":
            print(__version__, file=out)
            return sinks.EXIT_CLEAN
        if args.command == "config":
            return run_config(args, env, out, spark)
        rules = config.scan_rules(config.user_folder(env))
        spark = spark or _session()
        return {"deep": run_deep, "agents": run_deep, "fix": run_fix}.get(args.command, run_scan)(spark, args, rules, env, out)
    except (OSError, ValueError, RuntimeError, PySparkException) as error:
        print(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return sinks.EXIT_ERROR


if __name__ == "__main__":
    sys.exit(main())

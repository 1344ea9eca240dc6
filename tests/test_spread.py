"""Long files over several blocks of lines, and rule tables too large to broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import fix, lines
from vigil.operators import rules as R
from vigil.operators.scan import match_rules
from vigil.streaming.scan import gate


def files(pieces, seed):
    draw = random.Random(seed)
    out = []
    for file, n in (("a", 1), ("b", 2), ("c", 60), ("d", 61)):
        line = 0
        for _ in range(n):
            line += draw.choice((1, 1, 1, 2, 9))  # numbers may be missing
            out.append((file, line, draw.choice(pieces)))
    out += [("one run", k, pieces[-1]) for k in range(1, 30)]
    return out


def expected(rows, opens):
    spans, out = [], {}
    for k, (file, line, raw) in enumerate(rows):
        above = rows[k - 1] if k and rows[k - 1][0] == file else None
        if above is None or opens(raw, above[2]):
            spans.append([])
        spans[-1].append((file, line))
    for span in spans:
        out |= {at: (span[0][1], span[-1][1]) for at in span}
    return out


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_spans_run_on_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    shell = files(["ls", "cd \\\r", None, "make \\"], 1)
    fish = files(["- cmd: ls", "x", "  when: 1", "  paths:"], 2)
    for rows, spans, opens in (
        (shell, fix.shell_spans, lambda raw, above: not (above or "").endswith("\\")),
        (fish, fix.fish_spans, lambda raw, above: not raw.startswith(" ")),
    ):
        df = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "file string, line long, raw string")
        got = {(r.file, r.line): (r.span_start, r.span_end) for r in spans(df).collect()}
        assert got == expected(rows, opens)


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_fish_entries_run_on_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rows = files(["- cmd: ls", "  when: 12", "  when: soon", "  paths:"], 4)
    want, opened = {}, None
    for file, line, raw in rows:
        if raw.startswith("- cmd: "):
            opened = (file, line)
            want[opened] = (None, "ls")
        elif raw.startswith("  when: ") and opened and opened[0] == file:
            want[opened] = (12 if raw.endswith("12") else None, "ls")
    df = spark.createDataFrame(rows, "file string, line long, raw string")
    assert {(r.file, r.line): (r.ts, r.command) for r in lines.fish_entries(df).collect()} == want


def _words(seed):
    draw = random.Random(seed)
    return draw, lambda n: "".join(draw.choice("abé ") for _ in range(n))


def _fits(kind, text, pattern):
    return text == pattern if kind == "exact" else text.startswith(pattern) if kind == "prefix" else pattern in text


def test_rule_tables_of_any_size_give_what_plain_tests_give(spark, monkeypatch):
    draw, word = _words(5)
    texts = [word(draw.randrange(0, 9)) for _ in range(200)] + [None, "", "abab"]
    rules = [("check", draw.choice(("exact", "prefix", "substring")), word(draw.randrange(1, 7)), i) for i in range(60)]
    rules += [("check", "substring", "ab", 60), ("check", "substring", "ab", 61)]
    table = R.rule_table(spark, rules)
    entries = spark.createDataFrame(list(enumerate(texts)), "key long, command string")
    want = sorted((k, o) for k, t in enumerate(texts) if t is not None for _, m, p, o in rules if _fits(m, t, p))
    left = [k for k, t in enumerate(texts) if t is None or not any(_fits(m, t, p) for _, m, p, o in rules if o < 20)]
    for cells in (64 << 20, 1000):  # one pass, and several
        monkeypatch.setattr(R, "PASS_CELLS", cells)
        got = match_rules(entries, table)
        assert sorted((r.key, r.rule_ord) for r in got.collect()) == want
        assert all(r.pattern in r.token for r in got.collect())
        assert sorted(r.key for r in R.anti_match(entries, table.where("ord < 20")).select("key").collect()) == left
    assert match_rules(entries, table.where("ord < 0")).count() == 0 and R.anti_match(entries, table.where("ord < 0")).count() == len(texts)


def test_automata_find_what_plain_tests_find(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from vigil.functions import automaton as A

    for seed in range(60):
        draw, word = _words(seed)
        kinds = ("exact", "prefix", "substring")
        rules = [(draw.choice(kinds), word(draw.randrange(0 if seed % 5 == 0 else 1, 6))) for _ in range(draw.randrange(1, 40))]
        texts = [word(draw.randrange(0, 40)) for _ in range(20)]
        monkeypatch.setattr(A, "LANE", draw.choice((4, 4096)))
        raw, bounds = A.buffers(pa.array(["skipped", *texts]).slice(1))
        got = [pair for b in A.rule_blocks(rules, draw.choice((1, 2000, 1 << 20))) for pair in zip(*map(np.ndarray.tolist, b.matches(raw, bounds)))]
        assert sorted(got) == [(i, j) for i, t in enumerate(texts) for j, (m, p) in enumerate(rules) if _fits(m, t, p)]


@pytest.mark.parametrize("count", [1_001, 10_000, 100_000])
def test_many_rules(count):
    import hashlib

    import pyarrow as pa

    from vigil.functions import automaton as A

    name = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    rules = [(("exact", "prefix", "substring")[i % 3], name(i)[: 6 + i % 20]) for i in range(count)]
    texts = [f"{'' if i % 2 else 'echo '}{name(i)} {name(i + 1)}" for i in range(0, 3000, 3)] + [rules[0][1], rules[3][1]]
    got = A.matching(pa.array(texts), list(A.rule_blocks(rules))).to_pylist()
    by_size = {}
    for j, (m, p) in enumerate(rules):
        by_size.setdefault((m, len(p)), {}).setdefault(p, []).append(j)
    for t, found in zip(texts, got):
        want = []
        for (m, n), known in by_size.items():
            spots = [t] if m == "exact" and len(t) == n else [t[:n]] if m == "prefix" else {t[k : k + n] for k in range(len(t) - n + 1)} if m == "substring" else []
            want += [j for s in spots for j in known.get(s, ())]
        assert found == sorted(want)


def test_masks_never_miss_a_detector(spark):
    """Whatever a detector finds, its stage's bit is set."""
    from vigil.functions import fixed
    from vigil.functions.detectors import REGISTRY
    from vigil.functions.triggers import seen

    draw = random.Random(8)
    parts = [*fixed.KEY_MARKERS, *fixed.SSH_ALGORITHMS, *fixed.AUTH_PREFIXES, *fixed.USERINFO_FLAGS, *fixed.SECRET_FLAGS, *[p for p, _ in fixed.PREFIX_HINTS]]
    parts += ["-p", "=", "PASSWORD=", "api_Key=", "a://u:", "a://u:pw1@h", "-u a:b1 ", "@", " ", '"', "'", "$X", "é", "AAAAbbbb1234", "-", "_", ":", "http://h"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(0, 7))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "command string")
    command = F.col("command")
    found = rows.select(seen(command, [], []).alias("s"), *[F.size(detect(command)).alias(stage) for stage, detect in REGISTRY]).collect()
    fired = [0] * len(REGISTRY)
    for r in found:
        for i, (stage, _) in enumerate(REGISTRY):
            assert not r[stage] or r.s.mask >> i & 1
            fired[i] += r[stage] > 0
    assert min(fired) > 5


def test_rules_of_a_scan_however_many(spark):
    """Ignore and check rules as automata, also beyond what a plan would fold."""
    from vigil.operators.scan import scan

    entries = spark.createDataFrame([(1, "echo zz7_secret here"), (2, "ls zz7_ zz8_"), (3, "skip500 zz7_"), (4, None), (5, "ls")], "key long, command string")
    rules = [("ignore", "prefix", f"skip{i}", i) for i in range(600)] + [("check", "substring", f"zz{i}_", 600 + i) for i in range(600)]
    found = scan(entries, rules, redact=False).select("key", "ord", "token", "det_type").collect()
    assert sorted(map(tuple, found)) == [(1, 0, "zz7_secret", "config_check"), (2, 0, "zz7_", "config_check"), (2, 1, "zz8_", "config_check")]


def test_gate_judges_every_row_by_itself(spark):
    rows = [(1, "ls"), (1, "export API_KEY=a8Kd72Lm19xQpZ0vT4wY"), (2, None), (3, "export API_KEY=a8Kd72Lm19xQpZ0vT4wY # allow"), (4, "ls # deny")]
    gated = gate(spark.createDataFrame(rows, "key long, command string"))
    assert sorted((r.key, r.command or "", r.allowed) for r in gated.collect()) == sorted((k, c or "", a) for (k, c), a in zip(rows, (True, False, True, True, False)))
    assert "Exchange" not in gated._jdf.queryExecution().executedPlan().toString()


def test_sweep_keeps_what_no_span_covers(spark, monkeypatch):
    """Overlapping, nested and repeated spans, spans over many blocks, files
    without any, and lines whose numbers have gaps."""
    monkeypatch.setattr(lines, "BLOCK", 8)
    draw = random.Random(2)
    rows = [(f, n, f"{f}{n}") for f in "abc" for n in sorted(draw.sample(range(1, 200), 80))]
    spans = [(draw.choice("ab"), a, a + draw.choice((0, 1, 5, 60))) for a in draw.sample(range(1, 200), 12)]
    spans += [spans[0], ("a", 10**9, 2 * 10**9)]
    left = fix.remaining_lines(spark.createDataFrame(rows, "file string, line long, raw string"), spark.createDataFrame(spans, "file string, span_start long, span_end long"))
    assert left.columns == ["file", "line", "raw"]
    want = [r for r in rows if not any(r[0] == f and a <= r[1] <= b for f, a, b in spans)]
    assert sorted(map(tuple, left.collect())) == sorted(want) and 80 < len(want) < 240

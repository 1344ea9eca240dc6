"""Very many literals by hashes of windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.test_spread import _fits, _words
from vigil.functions import literals as L
from vigil.functions.automaton import buffers


@pytest.mark.parametrize("part", [1, 7, 1 << 19])
def test_literals_find_what_plain_tests_find(monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    for seed in range(40):
        draw, word = _words(seed)
        made = [(draw.choice(("prefix", "substring")), word(draw.randrange(0 if seed % 5 == 0 else 1, 12))) for _ in range(draw.randrange(1, 60))]
        rules = list(dict.fromkeys(made))
        texts = [word(draw.randrange(0, 60)) for _ in range(20)]
        monkeypatch.setattr(L, "COMPARED", draw.choice((1, 50, 1 << 22)))
        raw, bounds = buffers(pa.array(["skipped", *texts]).slice(1))
        got = L.Literals(*map(pa.array, zip(*rules))).matches(raw, bounds)
        assert list(zip(*map(np.ndarray.tolist, got))) == [(i, j) for i, t in enumerate(texts) for j, (m, p) in enumerate(rules) if _fits(m, t, p)]


def test_patterns_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(L, "_BASE", 1)  # the sum of the bytes
    monkeypatch.setattr(L, "_INVERSE", 1)
    rules = [("substring", "abc"), ("substring", "cba"), ("prefix", "bac"), ("prefix", "cab")]
    found = L.Literals(*map(pa.array, zip(*rules))).matching(pa.array(["xcba", None, "bacabc", "aaa", ""]))
    assert [list(zip(*map(np.ndarray.tolist, f))) for f in found] == [[(0, 1), (2, 0), (2, 2)]]


def test_a_rule_takes_few_bytes():
    """An automaton's table took some thousand bytes a rule, so that large rule
    tables needed pass after pass over the texts."""
    import pickle

    draw = random.Random(1)
    names = list(dict.fromkeys(hashlib.md5(str(draw.random()).encode()).hexdigest()[:12] for _ in range(100_000)))
    kinds = ["prefix" if i % 2 else "substring" for i in range(len(names))]
    assert len(pickle.dumps(L.Literals(pa.array(kinds), pa.array(names)))) < 64 * len(names)


def test_a_large_rule_table_is_one_pass(spark):
    """Sixty thousand rules took three passes, each over what the last had left."""
    from pyspark.sql import functions as F

    from vigil.operators import rules as R

    digest = F.md5(F.col("id").cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("exact", "prefix", "substring"))), (F.col("id") % 3 + 1).cast("int"))
    rules = spark.range(60_000).select(kind.alias("match_kind"), digest.alias("pattern"))
    assert [p.num_rows for p in R._passes(rules.where("match_kind <> 'exact'"), False)] == [40_000]
    texts = spark.range(59_990, 60_010).select("id", F.when(F.col("id") != 60_009, digest).alias("command"))
    assert sorted(r.id for r in R.anti_match(texts, rules).collect()) == list(range(60_000, 60_010))


@pytest.mark.parametrize("part", [1, 7, 1 << 19])
def test_whether_any_literal_is_found(monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    for seed in range(60):
        draw, word = _words(seed)
        made = [(draw.choice(("prefix", "substring")), word(draw.randrange(0 if seed % 5 == 0 else 1, 12))) for _ in range(draw.randrange(1, 20))]
        rules = list(dict.fromkeys(made))
        texts = [word(draw.randrange(0, 60)) for _ in range(20)]
        hit = L.Literals(*map(pa.array, zip(*rules))).hitting(pa.array(["skipped", None, *texts]).slice(1))
        assert hit.tolist() == [False, *(any(_fits(m, t, p) for m, p in rules) for t in texts)]


def test_a_text_is_left_at_its_first_match(monkeypatch):
    """Every occurrence of every pattern was looked up, so the work grew with
    the texts times the share of windows that are patterns."""
    looked, find = [], L.Sized.find
    monkeypatch.setattr(L.Sized, "find", lambda self, raw, begin, hashes: looked.append(len(begin)) or find(self, raw, begin, hashes))
    digits = [f"{i:03}" for i in range(1000)]
    texts = ["".join(digits[i : i + 100]) for i in range(900)] + ["x" * 300]
    literals = L.Literals(pa.array(["substring"] * 1000), pa.array(digits))
    assert literals.hitting(pa.array(texts)).tolist() == [True] * 900 + [False]
    assert sum(looked) < 4 * len(texts)


def test_rules_that_repeat_a_pattern_need_no_further_pass(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vigil.operators import rules as R

    monkeypatch.setattr(R, "PASS_CELLS", 1000)
    rules = spark.range(5000).select(F.lit("substring").alias("match_kind"), (F.col("id") % 5).cast("string").alias("pattern"))
    assert [p.num_rows for p in R._passes(rules, False)] == [5]
    texts = spark.createDataFrame([(1, "a4"), (2, "a5"), (3, None)], "key long, command string")
    assert sorted(r.key for r in R.anti_match(texts, rules).collect()) == [2, 3]

"""Very long texts, repeated rows, ties and clashing names, operator by operator."""

import json
import random

import numpy as np

from tests.llm.test_quality_rules import by_force as rules_by_force
from vigil.llm import pu_quality as pu
from vigil.llm import quality_rules as qr
from vigil.llm.chat import ChatFormatter
from vigil.llm.near_duplicates import NearDuplicates


def test_slopes_are_those_of_the_non_negative_risk():
    """Against differences of the risk itself, on either side of zero."""
    draw = np.random.default_rng(0)
    sides = set()
    for trial in range(20):
        m, n, prior = 7, 11, draw.uniform(0.05, 0.9)
        z = draw.normal(0, 2, m + n) + np.repeat([3.0 * (trial % 2), -4.0 * (trial % 2)], [m, n])
        negative = pu._risks(z, m, prior)[1] < 0
        sides.add(negative)
        risk = (lambda z: -pu._risks(z, m, prior)[1]) if negative else (lambda z: sum(pu._risks(z, m, prior)))
        got, step = pu._non_negative(m, n, prior)(z), 1e-6
        for k in range(m + n):
            away = np.eye(m + n)[k] * step
            assert abs((risk(z + away) - risk(z - away)) / (2 * step) - got[k]) < 1e-6
    assert sides == {True, False}


def test_classifier_on_repeats_ties_and_a_very_long_text(spark):
    draw = random.Random(1)
    good = lambda: " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) + str(draw.randint(0, 99)) for _ in range(60)) + "."
    bad = lambda: "buy now " * 30
    rows = [(i, good() if i % 2 else bad(), 1) for i in range(120)] + [(1, "alpha", 2)] * 2 + [(500, "word " * 400_000, 3), (501, None, 4), (502, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 1)] * 2 + [(5, None)], "doc_id long, quality int")
    scored = pu.QualityClassifier.fit(spark, docs, labels).score(docs, out="own").collect()
    assert len(scored) == len(rows) and all(0 <= r.own <= 1 for r in scored) and {r.score for r in scored} == {1, 2, 3, 4, 5}
    by_text = {}
    for r in scored:
        by_text.setdefault(r.text or "", set()).add(r.own)
    assert all(len(v) == 1 for v in by_text.values())  # equal texts, null and empty, score alike
    mean = lambda k: np.mean([r.own for r in scored if r.doc_id < 120 and r.doc_id % 2 == k and r.score == 1])
    assert mean(1) > mean(0) + 0.3


def test_rules_on_repeats_and_a_very_long_text(spark):
    texts = ["a b c d e " * 3] * 3 + ["w " * 300_000, "line x y\n" * 20_000, None, None]
    docs = spark.createDataFrame([(i // 2, t, 7, 8, True, "en") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, label int, kept boolean, lang string")
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.measure(docs).collect())
    assert got == sorted(rules_by_force(t) for t in texts)
    found = qr.apply_rules(spark, docs, spark.createDataFrame([(0, 1), (0, 1)], "doc_id long, quality int"))
    assert found.count() == len(texts)


def test_near_copies_of_a_very_long_text(spark):
    """100,000 words with a tenth of them changed in place, and one beyond the threshold."""
    draw = random.Random(6)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(100_000)]
    changed = lambda share: " ".join(w if draw.random() > share else "q" + w for w in base)
    rows = [(1, " ".join(base)), (2, changed(0.02)), (3, changed(0.3)), (4, " ".join(base)), (4, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in NearDuplicates(spark, 2, 0.8).find(docs).collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False), (4, 1, False)]


def test_near_duplicate_recall_at_the_threshold(spark):
    """Pairs whose similarity lies just above 0.8: all are linked."""
    draw = random.Random(8)
    rows, near = [], 0
    for k in range(150):
        words = [f"v{draw.randint(0, 10**6)}" for _ in range(200)]
        other = list(words)
        for i in draw.sample(range(0, 200, 2), 10):
            other[i] = "z" + other[i]
        a, b = (set(zip(x, x[1:])) for x in (words, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            near += 1
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in NearDuplicates(spark, 2, 0.8).find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near > 100 and all(got[i] == i - i % 2 for i in got)


def test_chat_with_very_long_content_beside_a_call(spark):
    long = "é\"\\\n" * 300_000
    rows = [(1, 0, "assistant", json.dumps({"content": long, "tool_calls": [{"id": "c", "name": "f", "arguments": {"x": long}}]})), (1, 1, "tool", json.dumps({"tool_call_id": "c", "content": long}))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.turn: json.loads(r.json) for r in ChatFormatter(spark, {"f": {"type": "object"}}).format(df).collect()}
    assert got[0]["content"] == long and got[0]["tool_calls"][0]["arguments"]["x"] == long and got[1]["content"] == long

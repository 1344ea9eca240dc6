"""Hard negatives against every pair, and bit-sliced products against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm.hard_negatives import OUTPUT, Anchors, First, HardNegatives, Planes, survivors

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, count=5, most=10):
    rows = [r for r in rows if r[2] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    length = max((len(r[1]) for r in rows), default=0)
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], x) for i, v, x in rows if len(v) == length]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, x) for b, (j, w, x) in enumerate(rows) if b != a]
        for score, j, _ in sorted((s for s in scored if s[2] == label), key=order)[:count]:
            window = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)[:most]
            out += [(i, j, n + 1, w[1], score, w[0]) for n, w in enumerate(window)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return sorted(map(tuple, HardNegatives(spark, **options).mine(df, F.col("vec_id") % 100 == 0).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200}])
def test_equals_all_pairs(spark, options):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.4, 6)], int(i * 7 % 4)) for i in range(0, 3000, 10)]
    assert mined(spark, rows, **options) == brute(rows)


def test_ties_copies_and_odd_rows(spark):
    """Groups of equal vectors, repeated rows (anchors among them), null ids,
    labels and vectors, entries that aren't finite, and short vectors."""
    r = random.Random(2)
    vectors = [[r.choice([0.0, 0.5, -0.5, 0.25]) for _ in range(4)] for _ in range(6)]
    rows = [(i * 25, r.choice(vectors), r.randint(0, 2)) for i in range(60)]
    rows += [(100, vectors[0], 1)] * 3 + [(None, vectors[1], 0), (None, vectors[2], 1), (7, None, 1), (9, [0.1, None, 0.2, 0.3], 1)]
    rows += [(200, [1.0, 2.0], 0), (300, [float("nan"), 0.0, 0.0, 0.0], 0), (400, [float("inf"), 0.0, 0.0, 0.0], 0), (500, vectors[3], None), (11, [], 0)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [0.5], 0)]) == []  # a negative positive has no window
    assert mined(spark, [(None, [1.0], 1), (0, None, 1)]) == []


def test_clashing_names(spark):
    rows = spark.createDataFrame([(0, [1.0], 1, 5, 6), (1, [1.0], 1, 5, 6), (2, [0.5], 0, 5, 6)], "vec_id long, embedding array<float>, label int, id int, x int")
    found = HardNegatives(spark).mine(rows, F.col("vec_id") == 0)
    assert [c.split()[0] for c in OUTPUT.split(", ")] == found.columns
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_large_components_are_refused(spark):
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e20], 1)])


def test_survivors_are_those_in_range():
    r = np.random.default_rng(1)
    a, b = r.integers(-300, 300, (40, 16)), r.integers(-300, 300, (90, 16))
    scores = a @ b.T
    floor, ceiling = np.quantile(scores, 0.97, axis=1), np.quantile(scores, 0.99, axis=1)
    x, y, value = survivors(Anchors(a, np.float32), np.arange(40), Planes(b, 10, np.float32), np.arange(90), floor, ceiling)
    want = np.argwhere((scores >= floor[:, None]) & (scores <= ceiling[:, None]))
    assert sorted(zip(x.tolist(), y.tolist())) == sorted(map(tuple, want.tolist()))
    assert (value == scores[x, y]).all()


def test_first_keeps_smallest_ids():
    first = First(2, 2)
    for score, i in ((5, 9), (5, 3), (5, 4), (4, 1)):
        first.add(np.array([1]), np.array([score]), np.array([i]), np.array([0]), np.array([0]))
    assert first.held[2].tolist() == [3, 4] and first.floor.tolist() == [-np.inf, 5]

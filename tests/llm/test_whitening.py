"""Whitening against a dense eigensolver over exact fractions of small tables."""

from fractions import Fraction

import numpy as np
import pytest

from vigil.llm.whitening import Whitener, lobpcg, orthonormal, scaled

KIND = "vec_id long, embedding array<float>"


def dense(vectors):
    """(n, x, sums, covariance) by exact integers."""
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(r, sums)] for r in x]
    d = len(sums)
    v = [[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)]
    return n, y, np.array(v)


def check(spark, rows, components):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    model = Whitener(spark, components=components).fit(df)
    vectors = [v for _, v in rows if v and None not in v and np.isfinite(v).all()]
    n, y, v = dense(vectors)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    k = len(model.values)
    assert model.n == n and np.isclose(model.trace, np.trace(v), rtol=1e-12)
    assert np.allclose(model.values, value[:k], rtol=1e-9)
    assert model.identity_error < 1e-9 and (model.residuals < 1e-11).all()
    found = {}
    for r in model.apply(df).collect():
        found.setdefault(r.vec_id, []).append((r.white.deviation, r.white["values"]))
    ids = [i for i, w in rows if w and None not in w and np.isfinite(w).all()]
    sign = np.sign((model.vectors * vector[:, :k]).sum(0))
    want = (np.array(y, float) / n) @ (vector[:, :k] * sign) / np.sqrt(value[:k])
    for i, own, white in zip(ids, y, want):
        deviations, values = zip(*found[i])
        assert sum(c * c for c in own) in deviations
        assert any(np.allclose(white, w, atol=1e-7) for w in values)
    assert sum(map(len, found.values())) == n
    return model


def test_equals_dense(spark):
    r = np.random.default_rng(0)
    mixed = r.normal(0, 1, (400, 12)) @ r.normal(0, 1, (12, 12))
    assert len(check(spark, [(i, v.tolist()) for i, v in enumerate(mixed)], 5).values) == 5


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(0, 2, (80, 5)))] + [(500, [1.0] * 5)] * 40 + [(None, [0.5] * 5)]
    rows += [(600, None), (601, [1.0, None, 1.0, 1.0, 1.0]), (602, [float("nan")] * 5), (603, [float("-inf")] * 5), (604, [])]
    assert len(check(spark, rows, 32).values) == 5


def test_shorter_vectors_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [9.0])], KIND)
    assert Whitener(spark).fit(df).n == 2


def test_directions_without_variance(spark):
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(20)]
    assert len(check(spark, line, 3).values) == 1
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9, [(1, None)]):
        df = spark.createDataFrame(rows, KIND)
        model = Whitener(spark).fit(df)
        assert len(model.values) == 0
        assert [r.white["values"] for r in model.apply(df).collect()] == [[]] * len([r for r in rows if r[1]])


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [0.0, 1.0], 7, 8)], "vec_id long, embedding array<float>, white int, cell int")
    found = Whitener(spark).fit(df).apply(df)
    assert found.columns == ["vec_id", "embedding", "white", "cell"]
    assert [len(r.white["values"]) for r in found.collect()] == [1, 1]


def test_large_deviation_is_exact_or_null(spark):
    df = spark.createDataFrame([(1, [2.0**40]), (2, [0.0]), (3, [1.0])], KIND)
    found = {r.vec_id: r.white.deviation for r in Whitener(spark).fit(df).apply(df).collect()}
    assert found[1] is None and found[2] is None or found[2] < 2**63


def test_lobpcg_with_more_columns_than_the_block():
    """The trial space is far smaller than the whole; clusters and a steep fall."""
    r = np.random.default_rng(2)
    basis = np.linalg.qr(r.normal(0, 1, (150, 150)))[0]
    values = np.concatenate((np.linspace(9, 8.9, 6), np.geomspace(5, 1e-3, 144)))
    v = (basis * values) @ basis.T
    value, vectors, residuals = lobpcg(lambda b: v @ b, 150, 8)
    assert np.allclose(value, np.sort(values)[::-1][:8], rtol=1e-12) and (residuals < 1e-11).all()
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


def test_orthonormal_leaves_out_what_adds_nothing():
    a = np.array([[1.0, 2.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 1e-14]])
    assert orthonormal(a).shape == (3, 2)
    assert orthonormal(a, np.eye(3)[:, :2]).shape[1] == 0


def test_too_large_entries_are_refused():
    with pytest.raises(ValueError):
        scaled(np.array([[1e30]]), 64, 0)

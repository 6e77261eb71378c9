"""Whitening against numpy's eigenvectors and whole numbers."""

import math

import numpy as np
import pytest

from tidegrid.llm import whitening


def rows(n, d, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.2 + r.normal(size=d)).astype(np.float32)


def run(spark, data, **more):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n int, whitened string").repartition(3)
    return whitening.whiten(df, **more).collect()


def check(out, good, components):
    ids = [i for i, _ in good]
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in good])
    n, d = x.shape
    v = np.cov(x.T.astype(float), bias=True).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    s = x.sum(0)
    far = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for i, r in zip(ids, x, strict=True)}
    white = (x - s / n) @ vectors[:, :components] / np.sqrt(values[:components])
    assert sorted((o.vec_id, o.component) for o in out) == sorted((i, k + 1) for i in ids for k in range(components))
    place = {i: k for k, i in enumerate(ids)}
    sign = {}
    for o in out:
        assert (o.n, o.deviation) == (n, far[o.vec_id])
        assert o.explained == pytest.approx(values[o.component - 1] / values.sum(), rel=1e-9)
        assert o.identity_error < 1e-9
        w = white[place[o.vec_id], o.component - 1]
        if abs(w) > 1e-6:
            sign.setdefault(o.component, np.sign(w * o.whitened))
        assert o.whitened == pytest.approx(w * sign.get(o.component, 1), abs=1e-7)
    assert len({o.identity_error for o in out}) == 1


def test_equals_plain_eigenvectors(spark):
    good = [(i, v.tolist()) for i, v in enumerate(rows(300, 12))]
    bad = [(900, None), (901, [1.0] * 11), (902, [float("nan")] + [0.0] * 11), (903, [None] + [0.0] * 11), (904, [float("inf")] * 12), (905, []), (906, [2.0**31] * 12)]
    out = run(spark, [(i, v, 1, "x") for i, v in good + bad])
    check(out, good, 8)


def test_few_dimensions_and_repeated_rows(spark):
    good = [(i, v.tolist()) for i, v in enumerate(rows(40, 3))]
    check(run(spark, [(i, v, 1, "x") for i, v in good]), good, 3)
    twice = run(spark, [(i, v, 1, "x") for i, v in good * 2])
    assert len(twice) == 2 * 40 * 3 and {o.n for o in twice} == {80}


def test_a_third_of_rows_is_one_vector(spark):
    good = [(i, v.tolist()) for i, v in enumerate(rows(200, 10))] + [(1000 + i, [0.25] * 10) for i in range(100)]
    check(run(spark, [(i, v, 1, "x") for i, v in good]), good, 8)


def test_without_variance(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 1, "x")]) == []
    assert run(spark, [(1, [1.0, 2.0], 1, "x")]) == [] and run(spark, [(i, [1.0, 2.0], 1, "x") for i in range(5)]) == []
    out = run(spark, [(i, [float(i), 1.0, 2.0 * i], 1, "x") for i in range(10)])  # rank 1
    assert {o.component for o in out} == {1} and out[0].explained == pytest.approx(1)


def test_deviations_beyond_64_bits(spark):
    x = np.array([[5, 7], [10**6, 3]], np.int64)
    n, sums = 10**9, [10**9 * 5 + 3, 10**9 * 4 - 1]
    got = whitening._deviations(x, n, sums, np.array([5, 4])).to_pylist()
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert got == [w if w < 1 << 63 else None for w in want] and got[1] is None


def test_jacobi_keeps_small_eigenvalues():
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.normal(size=(9, 9)))
    scale = np.diag(10.0 ** -np.arange(9))
    a = scale @ (q @ np.diag(np.linspace(1, 3, 9)) @ q.T) @ scale  # well scaled: small values are told to their own size
    values, vectors = whitening.jacobi(a)
    det = math.prod(values.tolist())
    assert det == pytest.approx(float(np.prod(np.linspace(1, 3, 9))) * 10.0 ** (-2 * 36), rel=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(9)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-15
    b = np.array([[2.0, 0.0], [0.0, 2.0]])
    assert whitening.jacobi(b)[0].tolist() == [2.0, 2.0]

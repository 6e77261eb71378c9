"""Variability by segments against plain NumPy."""

import numpy as np
import pytest

from tidegrid.operators import hrv


def entropy(x, share=0.2):
    r = share * x.std()

    def phi(m):
        rows = np.array([x[i : i + m] for i in range(len(x) - m + 1)])
        return np.log([(np.abs(rows - row).max(1) <= r).mean() for row in rows]).mean()

    return phi(2) - phi(3) if len(x) > 2 else None


def fluctuation(x, low, high):
    y, logs, sizes = np.cumsum(x - x.mean()), [], []
    for s in range(low, high + 1):
        if len(y) >= s:
            rest = [y[i : i + s] - np.polyval(np.polyfit(np.arange(s), y[i : i + s], 1), np.arange(s)) for i in range(0, len(y) - s + 1, s)]
            logs.append(0.5 * np.log(np.mean(np.square(rest)) + 1e-300))
            sizes.append(np.log(s))
    return np.polyfit(sizes, logs, 1)[0] if len(sizes) > 1 else None


def powers(x):
    t = np.cumsum(x) - x[0]
    even = np.interp(np.arange(0, t[-1] + 1e-6, 250), t, x)
    size = min(256, len(even))
    if size < 3:
        return None
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = [even[i : i + size] for i in range(0, len(even) - size + 1, size // 2)]
    p = np.mean([2 * np.abs(np.fft.rfft((q - q.mean()) * taper)) ** 2 / (4 * (taper**2).sum()) for q in parts], 0)
    f = np.arange(len(p)) * 4 / size
    return tuple(p[(f >= a) & (f < b)].sum() * 4 / size if ((f >= a) & (f < b)).any() else None for a, b in ((0.04, 0.15), (0.15, 0.4)))


def test_equals_plain_formulas(spark):
    r = np.random.default_rng(3)
    n = 400
    own = {
        ("a", 0): 800 + 60 * np.sin(np.arange(n) * 0.5) + r.normal(0, 20, n), ("a", 1): 700 + np.cumsum(r.normal(0, 5, 90)),
        ("b", 0): np.full(50, 900.0), ("b", 1): np.array([800.0, 810.0, 790.0]), ("c", 0): np.array([700.0]), ("c", 1): np.round(r.normal(800, 30, 20)),
    }
    rows = [(*k, i, float(v)) for k, x in own.items() for i, v in enumerate(x)]
    got = {(x.record_id, x.segment): x for x in hrv.nonlinear(spark.createDataFrame(rows, "record_id string, segment long, k long, nn double").repartition(3)).collect()}
    assert set(got) == set(own)
    for key, x in own.items():
        g = got[key]
        assert g.n == len(x)
        if key != ("b", 0):
            assert g.apen == (None if len(x) < 3 else pytest.approx(entropy(x), abs=1e-9)), key
            for name, low, high in (("alpha1", 4, 16), ("alpha2", 17, 64)):
                want = fluctuation(x, low, high)
                assert getattr(g, name) == (None if want is None else pytest.approx(want, abs=1e-6)), (key, name)
        want = powers(x)
        for a, b in zip((g.lf, g.hf), want or (None, None), strict=True):
            assert a == (None if b is None else pytest.approx(b, rel=1e-4, abs=1e-6)), key
    assert got["b", 0].apen == pytest.approx(0) and got["b", 0].lf == pytest.approx(0, abs=1e-9)
    assert got["a", 0].hf + got["a", 0].lf == pytest.approx(60**2 / 2, rel=0.5)  # the sine's power


def test_cut_by_minutes(spark):
    df = spark.createDataFrame([("a", i, 1000.0) for i in range(700)] + [("b", 5, 400_000.0)], "record_id string, t int, nn double")
    got = {(x.record_id, x.segment): x["count"] for x in hrv.by_minutes(df, "t").groupBy("record_id", "segment").count().collect()}
    assert got == {("a", 0): 299, ("a", 1): 300, ("a", 2): 101, ("b", 1): 1}
    assert sorted(x.k for x in hrv.by_minutes(df, "t").where("segment = 2").collect()) == list(range(101))


def test_no_rows(spark):
    none = spark.createDataFrame([], "record_id string, segment long, k long, nn double")
    assert hrv.nonlinear(none).collect() == []

import numpy as np
import pytest

from tidegrid.operators import ecg, features, kernels, series, skin
from tidegrid.sources import sensors


def rows(spark, values, columns="record_id int, ts_ns long, v double"):
    return spark.createDataFrame(values, columns)


def test_as_of_ties(spark):
    left = rows(spark, [(1, 10, 0.0), (1, 20, 0.0), (1, 30, 0.0), (2, 10, 0.0)]).select("record_id", "ts_ns")
    right = rows(spark, [(1, 10, 1.0), (1, 20, 2.0), (1, 40, None)])
    get = lambda d, s: sorted((x.record_id, x.ts_ns, x.v) for x in series.as_of(left, right, "v", d, s).collect())
    assert get("backward", False) == [(1, 10, 1.0), (1, 20, 2.0), (1, 30, 2.0), (2, 10, None)]
    assert get("backward", True) == [(1, 10, None), (1, 20, 1.0), (1, 30, 2.0), (2, 10, None)]
    assert get("forward", False) == [(1, 10, 1.0), (1, 20, 2.0), (1, 30, None), (2, 10, None)]
    assert get("forward", True) == [(1, 10, 2.0), (1, 20, None), (1, 30, None), (2, 10, None)]


def test_resampling_a_ramp_is_exact(spark):
    df = rows(spark, [(1, t, float(t)) for t in (0, 7, 11, 30, 31)])
    got = sorted((x.ts_ns, x.v) for x in series.resample(df, ["v"], 5).collect())
    assert got == [(t, pytest.approx(t)) for t in range(0, 31, 5)]
    assert series.resample(df.limit(0), ["v"], 5).count() == 0


def test_islands_of_one_and_at_the_end(spark):
    df = spark.createDataFrame([(1, i, int(b)) for i, b in enumerate("0110100011")], "record_id int, ts_ns long, bad int")
    assert sorted((x["first"], x["last"], x.length) for x in series.islands(df, "bad").collect()) == [(1, 2, 1), (4, 4, 0)]
    assert sorted(x.length for x in series.islands(df, "bad", drop_last=False, inclusive=True).collect()) == [1, 2, 2]


def test_filters_equal_their_recurrences(spark):
    x = np.random.default_rng(2).normal(size=120)
    low, high = np.zeros(120), np.zeros(120)
    g = lambda a, i: a[i] if i >= 0 else 0.0
    for i in range(120):
        low[i] = 2 * g(low, i - 1) - g(low, i - 2) + x[i] - 2 * g(x, i - 6) + g(x, i - 12)
        high[i] = -g(high, i - 1) - low[i] + 32 * g(low, i - 16) + g(low, i - 32)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "record_id int, i long, x double")
    out = ecg.high_pass(ecg.low_pass(df, "x"), "low").orderBy("i").collect()
    assert np.allclose([r.low for r in out], low) and np.allclose([r.high for r in out], high)


def test_spike_train_has_75_beats_a_minute(spark):
    fs, n = 250, 5000
    t = np.arange(n)
    x = sum(np.exp(-0.5 * ((t - p) / 5) ** 2) for p in range(150, n, 200))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "record_id int, i long, x double")
    peaks = kernels.qrs_peaks(ecg.front_end(df, "x", fs), fs)
    rate = ecg.heart_rate(peaks, fs).collect()[0].heart_rate
    assert rate == pytest.approx(75, abs=1)


def test_kernels():
    x = np.sin(np.arange(512) * 2 * np.pi * 8 / 64)
    f, p = kernels.power_spectrum(x, 64.0)
    assert f[p.argmax()] == pytest.approx(8, abs=0.3)
    assert kernels.hull_area(np.array([[0, 0], [2, 0], [2, 3], [0, 3], [1, 1]])) == pytest.approx(6)
    assert kernels.suppressed(np.array([0, 5, 0, 6, 0, 0, 0, 0, 3, 0.0]), 3, 0.1).tolist() == [3, 8]


def test_sources(spark, tmp_path):
    at = tmp_path / "rec1"
    at.mkdir()
    (at / "gaze.csv").write_text("timestamp [ns],gaze x [px],gaze y [px]\n5,1600,10\n6,1600.1,10\n7,,3\n8,-1,1200\n")
    got = sorted((x.record_id, x.ts_ns, x.status) for x in sensors.read_gaze(spark, f"{tmp_path}/*/gaze.csv").collect())
    assert got == [("rec1", 5, 1), ("rec1", 6, 0), ("rec1", 7, 0), ("rec1", 8, 1)]
    (at / "xECGmV.csv").write_text("a,b,c,d\n28/10/2023,23:59:59.500,0.5,1\n15/01/2024,12:00:00.000,0.25,2\n")
    got = sorted((x.ts_ns, x.ecg_lead_1) for x in sensors.read_ecg(spark, f"{tmp_path}/*/*ECGmV.csv").collect())
    assert got == [(1698530399500000000, 0.5), (1705316400000000000, 0.25)]
    (at / "eda.csv").write_text("unix_timestamp,eda\n3,0.5\n")
    assert sensors.read_micros(spark, f"{tmp_path}/*/eda.csv", "eda").collect()[0].ts_ns == 3000


def test_quality_rules(spark):
    df = spark.createDataFrame([(0.5, 10, 70.0, 900.0, 0.9), (0.9, 10, 70.0, 900.0, 0.9), (0.5, 10, 20.0, 900.0, 0.9)], "a double, b int, c double, d double, e double")
    assert [x.ok for x in df.select(ecg.acceptable(*(df[c] for c in "abcde")).alias("ok")).collect()] == [1, 0, 0]
    one = spark.createDataFrame([(1, 0.5), (1, 2.0)], "k int, x double")
    assert not features.is_normalised(one, ["k"], "x").collect()[0].normalised


def test_sparse_drivers_of_a_long_record(spark):
    rate, n = 4, 4 * 20 * 60
    t = np.arange(0, 10 + 1e-10, 1 / rate)
    response = np.exp(-t / 2) - np.exp(-t / 0.5)
    at = np.arange(10 * rate, n - 15 * rate, 12 * rate)
    x = np.full(n, 2.0)
    for p in at:
        x[p : p + len(response)] += response
    atoms, _ = skin.atoms(rate)
    assert atoms.shape == (480, 6 + 5 * 240) and np.allclose(np.linalg.norm(atoms[:, 6:], axis=0), 1)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, i, 1.5) for i in range(3)], "record_id int, i long, x double")
    rows = skin.series(df.where("record_id = 1"), "x", rate).orderBy("i").collect()
    driver, tonic, error = (np.array([r[c] for r in rows]) for c in ("driver", "tonic", "error"))
    near = np.array([driver[p - 2 : p + 3].sum() for p in at])
    assert len(at) > 90 and (near > 0.5 * np.linalg.norm(response)).all()
    assert error.mean() < 1e-3 and np.abs(tonic - 2).max() < 0.2
    got = {r.record_id: r for r in skin.totals(df, "x", rate).collect()}
    assert got[1].n_events >= len(at) and got[1].mse < 1e-3
    assert (got[2].tonic, got[2].n_events, got[2].driver, got[2].mse) == (1.5, 0, 0.0, 0.0)

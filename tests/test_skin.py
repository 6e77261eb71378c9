"""The positive lasso's path against its optimality conditions and a dense solver; the series of skin parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import skin


def test_factor_is_updated_and_downdated():
    r = np.random.default_rng(1)
    x = r.normal(size=(30, 8))
    gram, factor, active = x.T @ x, np.zeros((0, 0)), []
    for j in (3, 0, 7, 5, 1):
        factor = skin.joined(factor, gram[j, active], gram[j, j])
        active.append(j)
        assert np.allclose(factor, np.linalg.cholesky(gram[np.ix_(active, active)]))
    for k in (2, 0, 2):
        active.pop(k)
        factor = skin.left_out(factor, k)
        assert np.allclose(factor @ factor.T, gram[np.ix_(active, active)]) and np.allclose(factor, np.tril(factor))
    double = np.append(x, x[:, [3]] * 2, axis=1)
    assert skin.joined(np.linalg.cholesky(gram[3:4, 3:4]), double.T[8] @ double[:, [3]], double[:, 8] @ double[:, 8]) is None


def dense(gram, along, penalty, rounds=20_000):
    """Coordinate descent on half the squared rest plus the penalty times the sum of non-negative weights."""
    w = np.zeros(len(along))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            w[j] = max(0.0, (along[j] - gram[j] @ w + gram[j, j] * w[j] - penalty) / gram[j, j])
        if np.abs(w - before).max() < 1e-13:
            break
    return w


@pytest.mark.parametrize("seed", range(6))
def test_each_corner_is_optimal(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(20, 12)) + 1.2 * r.normal(size=(20, 1))  # alike, so that some leave again
    x /= np.linalg.norm(x, axis=0)
    y = x[:, :4] @ np.array([1.0, 0.5, 2.0, 0.1]) + 0.3 * r.normal(size=20)
    gram, along = x.T @ x, x.T @ y
    last = np.inf
    corners = list(skin.path(gram, along))
    for penalty, w in corners:
        rest = along - gram @ w
        assert penalty <= last + 1e-12 and (w >= 0).all()
        assert rest.max() <= penalty + 1e-9 and np.allclose(rest[w > 0], penalty, atol=1e-9)
        assert np.allclose(w, dense(gram, along, penalty), atol=1e-6)
        last = penalty
    assert corners[-1][0] == pytest.approx(0, abs=1e-12)


def test_an_atom_leaves_again():
    s = np.array([1, 1, 0.5]) / 1.5
    x = np.stack([s, [1.0, 0, 0], [0, 1.0, 0]], 1)
    gram, along = x.T @ x, x.T @ np.array([1, 0.9, -0.5])
    corners = list(skin.path(gram, along))
    used = [tuple(np.flatnonzero(w)) for _, w in corners]
    assert used[1] == (0,) and used[-1] == (1, 2) and any(0 in u for u in used)
    for penalty, w in corners:
        rest = along - gram @ w
        assert rest.max() <= penalty + 1e-9 and np.allclose(rest[w > 0], penalty) and np.allclose(w, dense(gram, along, penalty), atol=1e-6)


def test_degenerate_paths():
    assert list(skin.path(np.eye(3), np.array([-1.0, -2.0, 0.0]))) == []
    x = np.ones((4, 3)) / 2  # three times the same atom
    corners = list(skin.path(x.T @ x, x.T @ np.ones(4)))
    assert corners[-1][1].sum() == pytest.approx(2) and corners[-1][0] == pytest.approx(0)


def signal(seconds, rate, seed=1, every=25):
    r = np.random.default_rng(seed)
    n = round(seconds * rate)
    driver = np.zeros(n)
    driver[np.arange(30, n - 40, round(every * rate)) + r.integers(0, 20, len(range(30, n - 40, round(every * rate))))] = r.uniform(0.5, 3)
    x, _ = skin.atoms(rate)
    shape = x[: round(10 * rate), 6 + 2 * round(60 * rate)]
    return 2 + 0.5 * np.sin(np.arange(n) / rate / 60) + np.convolve(driver, shape)[:n], driver


def frame(spark, signals):
    return spark.createDataFrame([(k, i, float(v)) for k, s in signals.items() for i, v in enumerate(s)], "record_id string, i int, x double")


def test_parts_add_up_and_events_are_found(spark):
    rate = 4.0
    signals = {"a": signal(400, rate, 1)[0], "b": signal(130, rate, 2)[0], "c": np.array([1.5]), "d": np.full(700, 3.0), "e": signal(125, rate, 3)[0][:300]}
    df = frame(spark, signals)
    parts = skin.series(df, "x", rate)
    rows = {}
    for p in parts.orderBy("record_id", "i").collect():
        rows.setdefault(p.record_id, []).append(p)
    assert {k: [p.i for p in v] for k, v in rows.items()} == {k: list(range(len(s))) for k, s in signals.items()}
    for k, v in rows.items():
        rest = np.array([(s - p.tonic - p.phasic) ** 2 - p.error for s, p in zip(signals[k], v, strict=True)])
        assert np.abs(rest).max() < 1e-9 and all(p.driver >= 0 for p in v)
        assert np.mean([p.error for p in v]) < 0.01
    flat = rows["d"]
    assert max(p.phasic for p in flat) == 0 and all(p.tonic == pytest.approx(3) for p in flat)
    kept = {(w.record_id, w.window): w.n for w in skin.windows(parts).collect()}
    last = max(w for k, w in kept if k == "a")
    assert all(n in (80, 160, 240) for (k, w), n in kept.items() if k == "a" and 0 < w < last)
    found = sorted(e.i for e in skin.events(parts.where("record_id = 'a'"), 4, 0.05).collect())
    true = np.flatnonzero(signal(400, rate, 1)[1])
    # A window has no onsets after its first 60 s, so its last ones take up what comes then.
    edges = [w.first for w in skin.windows(parts.where("record_id = 'a'")).collect()]
    assert all(min(abs(f - t) for f in found) <= 2 for t in true if min(abs(t - e) for e in edges) > 4)


def test_a_record_of_two_hours_in_pieces(spark):
    rate = 4.0
    y, _ = signal(7200, rate, 5, every=40)
    df = frame(spark, {"long": y, "short": y[:400]})
    parts = skin.series(df, "x", rate)
    got = {k.record_id: k for k in parts.groupBy("record_id").agg(F.count("*").alias("n"), F.max("error").alias("worst"), F.max("i").alias("last"), F.max("window").alias("windows")).collect()}
    assert (got["long"].n, got["long"].last, got["short"].n) == (len(y), len(y) - 1, 400) and got["long"].windows >= 120
    # However the rows come in, a record's windows are the same.
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
        pieces = skin.series(df.where("record_id = 'short'"), "x", rate).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    assert pieces == skin.series(df.where("record_id = 'short'"), "x", rate).orderBy("i").collect()


def test_events_as_a_plain_loop(spark):
    r = np.random.default_rng(7)
    signals = {k: np.round(np.maximum(r.normal(size=n), 0), 1) for k, n in (("a", 200), ("b", 1), ("c", 60))}
    df = frame(spark, signals).withColumnRenamed("x", "driver")
    got = sorted((e.record_id, e.i, e.driver) for e in skin.events(df, 5, 0.4).collect())
    want = []
    for k, s in signals.items():
        kept = []
        for p in sorted(np.flatnonzero(s > 0).tolist(), key=lambda i: (-s[i], i)):
            if all(abs(p - q) >= 5 for q in kept):
                kept.append(p)
        want += [(k, p, s[p]) for p in kept if s[p] >= 0.4 * s.max()]
    assert got == sorted(want)


def test_scaled_by_the_quantile(spark):
    y = np.linspace(0, 1, 1001)
    df = frame(spark, {"a": y, "z": np.zeros(5)}).withColumnRenamed("x", "phasic")
    got = {(x.record_id, x.i): x.scr for x in skin.scaled(df).collect()}
    assert got["a", 500] == pytest.approx(0.5 / 0.995) and got["z", 1] is None


def test_each_record_is_fitted_once(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(8)
    own = spark.createDataFrame([(k, i, float(v)) for k in range(6) for i, v in enumerate(r.normal(0, 1, 90))], "record_id long, i long, x double")
    plain = skin._parts

    def told(rate):
        run = plain(rate)

        def noted(batches):
            for part in run(batches):
                with open(tmp_path / "parts", "a") as f:
                    f.write("".join(f"{k} {i}\n" for k, i in zip(part.column("record_id").to_pylist(), part.column("i").to_pylist(), strict=True)))
                yield part

        return noted

    monkeypatch.setattr(skin, "_parts", told)
    for name, rows in (("scaled", lambda: skin.scaled(skin.series(own, "x", 4.0)).count()), ("totals", lambda: len(skin.totals(own, "x", 4.0).collect()))):
        assert rows() == {"scaled": 540, "totals": 6}[name]
        lines = (tmp_path / "parts").read_text().split("\n")[:-1]
        assert len(lines) == len(set(lines)) == 540, name
        (tmp_path / "parts").write_text("")

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegrid import streaming
from tidegrid.functions import finite, wall_clock
from tidegrid.operators import features, gaze, kernels, quality, series
from tidegrid.sources import bundles, sensors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bounds_differ_at_the_start(spark):
    df = frame(spark, [(1, t) for t in (1, 2, 3, 4)], "record_id int, ts_ns long")
    bounds = frame(spark, [(1, 2, 3)], "record_id int, start_ns long, end_ns long")
    assert sorted(x.ts_ns for x in quality.between_closed(df, bounds).collect()) == [2, 3]
    assert [x.ts_ns for x in quality.after_until(df, bounds).collect()] == [3]


def test_a_failed_requirement_stops_the_job(spark):
    df = frame(spark, [(1, 0.5), (2, None)], "record_id int, share double")
    assert quality.required(df, "record_id > 0", "no").count() == 2
    with pytest.raises(PySparkException):
        quality.required(df, "share < 1", "too many nulls").collect()


def test_overlap_of_sensors(spark):
    a = frame(spark, [(1, 0), (1, 10), (2, 0), (2, 5), (3, 1)], "record_id int, ts_ns long")
    b = frame(spark, [(1, 4), (1, 20), (2, 6), (2, 9), (4, 1)], "record_id int, ts_ns long")
    got = {x.record_id: (x.overlap_ns, x.ok) for x in quality.span_overlaps(a, b).collect()}
    assert got == {1: (6, True), 2: (0, False), 3: (0, False), 4: (0, False)}


def test_next_temperature_or_the_last(spark):
    left = frame(spark, [(1, 10), (1, 20), (1, 30), (2, 5)], "record_id int, ts_ns long")
    right = frame(spark, [(1, 20, 1.0), (1, 25, 2.0), (1, 40, 3.0)], "record_id int, ts_ns long, temperature double")
    got = sorted((x.record_id, x.ts_ns, x.temperature) for x in quality.as_of_or_last(left, right, "temperature").collect())
    assert got == [(1, 10, 1.0), (1, 20, 2.0), (1, 30, 3.0), (2, 5, None)]


def test_intervals_without_invalid_ends(spark):
    peaks = frame(spark, [(1, i) for i in (0, 2, 4, 6, 11, 12)], "record_id int, i long")
    samples = frame(spark, [(1, i, int(i != 4)) for i in range(20)], "record_id int, i long, status int")
    got = sorted((x.segment, x.i, x.nn) for x in quality.nn_intervals(peaks, samples, 2.0, 10).collect())
    assert got == [(0, 2, 1000.0), (1, 12, 500.0)]


def test_flat_windows_and_constant_beats(spark):
    rows = [(1, i, 5.0) for i in range(400)] + [(2, i, math.sin(i)) for i in range(400)]
    df = frame(spark, rows, "record_id int, i long, x double")
    peaks = frame(spark, [(r, i) for r in (1, 2) for i in (50, 100, 150)], "record_id int, i long")
    got = {x.record_id: x for x in quality.heart_quality(df, peaks, "x", 50.0).collect()}
    assert got[1].flat_share > 0.8 and got[1].i_score is None and got[1].acceptable == 0
    assert got[2].flat_share < 0.01 and got[2].heart_rate == 60 and got[2].i_score < 1


def test_mean_correlation_equals_all_pairs(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=120)
    at = [20, 41, 60, 80, 101, 118]
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate(x)], "record_id int, i long, x double")
    got = quality.heart_quality(df, frame(spark, [(1, i) for i in at], "record_id int, i long"), "x", 20.0, width=20, hop=5).head().i_score
    half = int(np.round(min(np.mean(np.diff(at)), np.median(np.diff(at))) / 2))
    beats = [x[i - half : i + half + 1] for i in at if i - half >= 0 and i + half < len(x)]
    assert got == pytest.approx(np.corrcoef(beats).mean())


def test_beat_clusters_by_hand(spark):
    m = np.array([[1, 0.9, 0.9, 0.2, 0.1, 0.3], [0.9, 1, 0.9, 0.2, 0.1, 0.3], [0.9, 0.9, 1, 0.2, 0.1, 0.3], [0.2, 0.2, 0.2, 1, 0.95, 0.1], [0.1, 0.1, 0.1, 0.95, 1, 0.1], [0.3, 0.3, 0.3, 0.1, 0.1, 1]])
    rows = [(1, i, j, float(m[i, j])) for i in range(6) for j in range(6)] + [(2, i, j, 1.0) for i in range(2) for j in range(2)]
    got = {x.win: x for x in quality.beat_clusters(frame(spark, rows, "win int, beat int, other int, r double"), "win", "beat", low=0.4).collect()}
    group = 0.95 * (1.7 * math.exp(-0.5) - 0.005)
    noise = 1.6 * math.exp(-0.4) - 0.01
    assert (got[1].n_suspects, got[1].n_groups, got[1].n_noise) == (3, 1, 1)
    assert got[1].a_score == pytest.approx(((group + noise) / 2 + m[:3, :3].mean()) / 2)
    assert got[2].a_score is None


def test_recurrence_lines_by_brute_force(spark):
    p = np.random.default_rng(5).normal(size=(20, 2))
    df = frame(spark, [(1, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "record_id int, i long, x double, y double")
    near = {(i, j) for i in range(20) for j in range(i + 1, 20) if np.hypot(*(p[i] - p[j])) <= 1}
    diagonal = [q for q in near if (q[0] + 1, q[1] + 1) in near or (q[0] - 1, q[1] - 1) in near]
    vertical = [q for q in near if (q[0], q[1] + 1) in near or (q[0], q[1] - 1) in near]
    got = gaze.recurrence_lines(df, 1.0).head()
    assert (got.recurrence, got.determinism, got.laminarity) == pytest.approx((len(near) / 190, len(diagonal) / len(near), len(vertical) / len(near)))


def test_recurrence_lines_keep_pairs_in_their_tasks(spark):
    r = np.random.default_rng(9)
    sizes = {1: 2, 2: 1, 3: 40, 4: 300, 5: 7}
    rows = [(k, 2 * i - i % 3, *(None if v > 1.9 else float(v) for v in r.normal(size=2))) for k, n in sizes.items() for i in range(n)]  # gaps, null places and equal i
    df = frame(spark, rows, "record_id int, i long, x double, y double")
    out = gaze.recurrence_lines(df, 1.0)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.record_id: x for x in out.collect()}
    assert set(got) == {1, 3, 4, 5}
    for k in got:
        own = sorted((p[1:] for p in rows if p[0] == k), key=lambda p: p[0])
        pairs = [(a, b) for n, a in enumerate(own) for b in own[n + 1 :] if a[0] < b[0] and None not in (*a, *b)]
        near = [(a[0], b[0]) for a, b in pairs if math.hypot(a[1] - b[1], a[2] - b[2]) <= 1]
        assert got[k].recurrence == pytest.approx(len(near) / len(pairs))
        for name, key in (("determinism", lambda p: (p[1] - p[0], p[0])), ("laminarity", lambda p: p)):
            runs = {}
            for line in {key(p)[0] for p in near}:
                for n, place in enumerate(sorted(key(p)[1] for p in near if key(p)[0] == line)):
                    runs[line, place - n] = runs.get((line, place - n), 0) + 1
            want = sum(c for c in runs.values() if c > 1) / sum(runs.values()) if runs else None
            assert getattr(got[k], name) == (want if want is None else pytest.approx(want)), (k, name)


def test_exact_quantiles(spark):
    r = np.random.default_rng(6)
    groups = {1: r.normal(size=301).tolist(), 2: [3.0] * 40, 3: [1.0], 4: r.integers(0, 5, 100).astype(float).tolist(), 5: [*r.normal(size=50).tolist(), 1e9]}
    df = frame(spark, [(k, v) for k, vs in groups.items() for v in vs] + [(6, None)], "g int, v double")
    shares = [0.1, 0.25, 0.5, 0.995, 1.0]
    for bins in (4096, 3):
        got = {(x.g, x.share): x.value for x in series.quantiles(df, ["g"], "v", shares, bins).collect()}
        want = {(k, q): float(np.quantile(vs, q)) for k, vs in groups.items() for q in shares}
        assert got == pytest.approx(want)


def test_clock_changes_and_finite_values(spark):
    df = frame(spark, [("31/03/2024", "02:30:00.000"), ("27/10/2024", "02:30:00.000"), ("27/10/2024", "04:30:00.000"), ("x", "y")], "d string, t string")
    assert [x.w for x in df.select(wall_clock(F.col("d"), F.col("t"), "Europe/Paris").alias("w")).collect()] == ["missing", "ambiguous", "ok", None]
    v = frame(spark, [(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [x.f for x in v.select(finite(F.col("v")).alias("f")).collect()] == [True, False, False, False]


def test_readers(spark, tmp_path):
    rec = tmp_path / "r1"
    rec.mkdir()
    (rec / "mappedGaze.csv").write_text("timestamp [ns],worldFrame,world_gazeX,world_gazeY,ref_gazeX,ref_gazeY,number_point_matches\n5,1,2.5,3.5,,4.5,\n")
    row = sensors.read_mapped_gaze(spark, f"{tmp_path}/*/mappedGaze*.csv").head()
    assert (row.record_id, row.ts_ns, row.frame, row.refX, row.refY, row.matches) == ("r1", 5, 1, None, 4.5, None)
    (rec / "limb.csv").write_text("// made by a sensor\nPacketCounter,Acc_X\n1,0.5\n2,-0.5\n")
    got = sensors.read_after_preamble(spark, f"{tmp_path}/*/limb.csv", "n INT, x DOUBLE").collect()
    assert sorted((x.n, x.x, x.record_id) for x in got) == [(1, 0.5, "r1"), (2, -0.5, "r1")]
    (rec / "info.yaml").write_text("railway_line: 'A line'  # comment\ndriver: d 7\nstart_offset: \"75:10\"\n")
    side = sensors.read_sidecars(spark, f"{tmp_path}/*/info.yaml").head()
    assert (side.record_id, side.line, side.subject, side.start_ns, side.end_ns) == ("r1", "A line", "d 7", 4510 * 10**9, None)
    (rec / "Acc_X_psd.csv").write_text("Frequency_Hz,Normalized_PSD\n0.5,0.25\n")
    assert sensors.read_spectra(spark, f"{tmp_path}/*/*_psd.csv").head()[1:] == ("Acc", "X", 0.5, 0.25)
    assert sensors.first_files(spark, f"{tmp_path}/*/*_psd.csv").head().path.endswith("Acc_X_psd.csv")
    assert sensors.read_columns(spark, f"{tmp_path}/*/limb.csv", "n STRING, x STRING", ["n"]).columns == ["n"]
    (rec / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        sensors.read_columns(spark, f"{tmp_path}/*/empty.csv", "a INT, b INT", ["a"])


def test_settings_of_any_depth(spark, tmp_path):
    rec = tmp_path / "r1"
    rec.mkdir()
    (rec / "info.yaml").write_text("driver: d 7\nrates:\n  gaze: 200\n  plan: !!float 1600\nlimits: [1, {low: 0.5}]\nbinning: True\nnone:\n")
    got = {x.key: x.value for x in sensors.read_settings(spark, f"{tmp_path}/*/info.yaml").where("record_id = 'r1'").collect()}
    assert got == {"driver": "d 7", "rates.gaze": "200", "rates.plan": "1600.0", "limits.0": "1", "limits.1.low": "0.5", "binning": "true", "none": None}


def test_bundles_are_typed(spark, tmp_path):
    df = frame(spark, [(1, 2, "a", "m", 0.5, "x"), (1, 2, "b", "m", None, "x")], "record_id int, segment int, family string, metric string, value float, more string")
    bundles.write(df, str(tmp_path), "features")
    out = bundles.read(spark, str(tmp_path), "features")
    assert dict(out.dtypes) == {"record_id": "bigint", "segment": "bigint", "metric": "string", "value": "double", "family": "string"}
    assert [tuple(x) for x in out.where("family = 'a'").collect()] == [(1, 2, "m", 0.5, "a")] and out.count() == 2
    with pytest.raises(ValueError, match="needs"):
        bundles.write(df.drop("value"), str(tmp_path), "features")


def test_one_annotator_where_frames_differ(spark):
    a = [(1, 5, 103.0, 104.0, 100.0, 100.0), (1, 6, 600.0, 100.0, 600.0, 100.0), (2, 7, 100.0, 110.0, 100.0, 100.0), (2, 8, 0.0, 0.0, 1.0, 1.0)]
    b = [(1, 5, 100.0, 115.0, 100.0, 100.0), (1, 6, 600.0, 100.0, 600.0, 100.0), (2, 7, 100.0, 130.0, 100.0, 100.0)]
    schema = "record int, frame int, x double, y double, mx double, my double"
    got = sorted(tuple(x) for x in features.annotation_distances(frame(spark, a, schema), frame(spark, b, schema)).collect())
    assert got == [(1, 5, True, pytest.approx(10 / 750)), (2, 7, False, pytest.approx(30 / 750))]


def test_blink_intervals(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "blinks.csv").write_text("start timestamp [ns],end timestamp [ns]\n5,9\n1700000000000000001,1700000000000000002\n")
    got = sorted((x.record_id, x.start_ns, x.end_ns) for x in sensors.read_blinks(spark, f"{tmp_path}/*/blinks.csv").collect())
    assert got == [("r1", 5, 9), ("r1", 1700000000000000001, 1700000000000000002)]


def test_suppression_keeps_a_peak_at_the_distance():
    assert kernels.suppressed(np.array([0, 9, 0, 0, 0, 5, 0.0]), 4, 0.005).tolist() == [1, 5]
    assert kernels.suppressed(np.array([0, 9, 0, 0, 5, 0.0]), 4, 0.005).tolist() == [1]


def test_streamed_shares(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", int(s % 3 > 0)) for s in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "record_id int, ts string, ok int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    batch = sorted(tuple(x) for x in streaming.valid_shares(df).collect())
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streaming.valid_shares(stream).writeStream.format("memory").queryName("shares").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(x) for x in spark.table("shares").collect()) == batch and len(batch) == 6
    assert [x.n for x in streaming.sessions(df, gap="5 seconds").collect()] == [30]


def test_feature_files_hold_many_records(spark, tmp_path):
    rows = [(f"a b={k}" if k else None, s, None if s == 2 else k + s / 3) for k in range(300) for s in range(4)]
    sensors.write_features(frame(spark, rows, "record_id string, segment long, mean double"), str(tmp_path), "skin")
    files = list((tmp_path / "skin").rglob("*.csv"))
    assert 0 < len(files) <= 8
    held = [[line.split(",")[0] for line in f.read_text().splitlines()[1:]] for f in files]
    records = [r for f in held for n, r in enumerate(f) if not n or f[n - 1] != r]
    assert len(records) == len(set(records)) == 300  # of each one run in one file
    back = spark.read.schema("record_id string, segment long, mean double").csv(str(tmp_path / "skin"), header=True)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, frame(spark, rows, back.schema).collect()))

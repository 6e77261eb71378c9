"""Scanpath operators against plain Python."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import gaze, scanpath


def on_curve(d, side):
    """The cell at a place of the Hilbert curve."""
    x = y = 0
    s = 1
    while s < side:
        right, up = 1 & (d // 2), 1 & (d ^ (d // 2))
        if not up:
            if right:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, d, s = x + s * right, y + s * up, d // 4, s * 2
    return x, y


def test_hilbert_order_is_inverted(spark):
    for n in (1, 3, 4):
        side = 1 << n
        df = spark.range(side * side).select((F.col("id") % side).alias("x"), F.expr(f"id div {side}").alias("y"))
        got = {(r.x, r.y): r.d for r in df.select("x", "y", scanpath.hilbert(F.col("x"), F.col("y"), n).alias("d")).collect()}
        assert {v: k for k, v in got.items()} == {d: on_curve(d, side) for d in range(side * side)}
    edge = spark.createDataFrame([(-9.0,), (0.0,), (9.99,), (10.0,), (99.0,), (5.0,)], "v double")
    assert [r.g for r in edge.select(scanpath.on_grid(F.col("v"), 0, 10).alias("g")).collect()] == [0, 0, 15, 15, 15, 8]


def higuchi(x, kmax=10):
    ks = [k for k in range(1, kmax + 1) if len(x) > 2 * k]
    if len(ks) < 2:
        return None
    each = [[sum(abs(x[i] - x[i - k]) for i in range(m + k, len(x), k)) * (len(x) - 1) / ((len(x) - 1 - m) // k * k * k) for m in range(k)] for k in ks]
    return np.polyfit([-math.log(k) for k in ks], [math.log(np.mean(e) + 1e-300) for e in each], 1)[0]


def test_higuchi(spark):
    r = random.Random(1)
    own = {"line": [float(i) for i in range(100)], "noise": [r.gauss(0, 1) for _ in range(600)], "few": [1.0, 2.0, 4.0], "five": [1.0, 5.0, 2.0, 2.5, 7.0], "seven": [r.random() for _ in range(7)]}
    df = spark.createDataFrame([(k, i, v) for k, s in own.items() for i, v in enumerate(s)], "record_id string, i long, d double")
    got = {x.record_id: x.fractal_dimension for x in scanpath.higuchi(df, ["record_id"], "d", "i").collect()}
    assert got == {k: (None if higuchi(v) is None else pytest.approx(higuchi(v), abs=1e-9)) for k, v in own.items()}
    assert got["line"] == pytest.approx(1) and got["noise"] == pytest.approx(2, abs=0.1)


def shifted(p, bandwidth):
    labels, centres = [], []
    for start in p:
        m = start
        for _ in range(50):
            new = p[((p - m) ** 2).sum(1) <= bandwidth**2].mean(0)
            far, m = np.abs(new - m).max(), new
            if far < 1e-6:
                break
        m = m.round(6)
        hit = next((k for k, c in enumerate(centres) if ((c - m) ** 2).sum() <= bandwidth**2), len(centres))
        if hit == len(centres):
            centres.append(m)
        labels.append(hit)
    return labels


def test_mean_shift_on_two_thousand_points(spark):
    r = np.random.default_rng(2)
    p = np.concatenate([r.normal(c, 12, (400, 2)) for c in ((0, 0), (90, 10), (30, 120), (-80, 60))] + [r.uniform(-150, 150, (380, 2)), np.tile([[5.0, 5.0]], (20, 1))])
    r.shuffle(p)
    few = np.array([[0.0, 0], [1, 0], [50, 50], [51, 50]])
    rows = [("big", i, *map(float, q)) for i, q in enumerate(p)] + [("few", i, *map(float, q)) for i, q in enumerate(few)] + [("one", 0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "record_id string, i long, x double, y double")
    got = {}
    for x in scanpath.mean_shift(df, ["record_id"], "i", 25.0).collect():
        got.setdefault(x.record_id, {})[x.i] = x.area
    assert got == {"big": dict(enumerate(shifted(p, 25.0))), "few": {0: 0, 1: 0, 2: 1, 3: 1}, "one": {0: 0}}
    assert scanpath.mean_shift(df.where("false"), ["record_id"], "i", 25.0).collect() == []


def parsed(s):
    n, i, count = len(s), 0, 0
    while i < n:
        size = 1
        while i + size <= n and any(s[j : j + size] == s[i : i + size] for j in range(i)):
            size += 1
        count, i = count + 1, i + size
    return count


def test_phrases_by_the_plain_parsing(spark):
    r = random.Random(3)
    for k in (1, 2, 3, 20):
        for n in (0, 1, 2, 7, 60):
            for _ in range(20):
                s = [r.randrange(k) for _ in range(n)]
                assert scanpath.phrases(s) == parsed(s), s
    assert scanpath.phrases("aaaaaaaa") == 2 and scanpath.phrases("abcabcabd") == parsed("abcabcabd")
    began = time.perf_counter()
    long = [r.randrange(4) for _ in range(100_000)]
    assert 5_000 < scanpath.phrases(long) < 20_000 and scanpath.phrases([1] * 100_000) == 2
    assert time.perf_counter() - began < 20
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("abab")] + [(2, 0, "z")], "record_id int, i int, s string")
    assert sorted(tuple(x) for x in scanpath.lempel_ziv(df, ["record_id"], "s", "i").collect()) == [(1, 3), (2, 1)]


def test_states_are_the_likeliest_of_all_paths(spark):
    r = np.random.default_rng(4)
    stay = 0.9
    rows, want = [], {}
    for n in range(40):
        v = np.round(np.abs(r.normal(0, 1, r.integers(4, 11))) * r.choice([1, 6], 1), 2)
        slow = (v <= np.median(v)).astype(int)
        if slow.all() or not slow.any():
            continue
        cost = [(v - v[slow == k].mean()) ** 2 / (2 * (v[slow == k].var() + 1e-9)) + 0.5 * np.log(v[slow == k].var() + 1e-9) for k in (0, 1)]
        paths = list(itertools.product((0, 1), repeat=len(v)))
        total = [sum(cost[s][t] for t, s in enumerate(p)) - sum(np.log(stay if a == b else 1 - stay) for a, b in zip(p, p[1:], strict=False)) for p in paths]
        best = np.argsort(total)
        if total[best[1]] - total[best[0]] > 1e-9:
            want[n] = list(paths[best[0]])
            rows.append((n, v.tolist(), slow.tolist()))
    df = spark.createDataFrame(rows, "n int, v array<double>, s array<int>")
    assert {x.n: x.p for x in df.select("n", gaze.decoded(F.col("v"), F.col("s"), stay).alias("p")).collect()} == want and len(want) > 30


def test_fixations_of_a_still_gaze_and_jumps(spark):
    at = [(0, 0)] * 10 + [(40, 0), (80, 0)] + [(100, 0)] * 10
    r = np.random.default_rng(5)
    pts = [(1, i, float(x + r.normal(0, 0.1)), float(y + r.normal(0, 0.1))) for i, (x, y) in enumerate(at)] + [(2, i, 5.0, 5.0) for i in range(6)] + [(3, 0, 1.0, 1.0)]
    out = gaze.fixations(spark.createDataFrame(pts, "record_id int, i long, x double, y double"), "record_id", "i", 200.0).orderBy("record_id", "first").collect()
    assert [(x.record_id, x.first, x.last) for x in out] == [(1, 0, 8), (1, 12, 21), (2, 0, 5)]
    speeds = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 1.1, 0.9, 1.0, 50.0, 55.0, 52.0, 1.0, 1.2, 1.0])], "k int, i int, v double")
    assert [x.slow for x in gaze.slow_states(speeds, "k", "i", "v").orderBy("i").collect()] == [1, 1, 1, 1, 0, 0, 0, 1, 1, 1]


def test_shapes_of_saccades(spark):
    tri = [(0, 0), (1, 1), (2, 0)]  # to the left of its chord
    back = [(2, 0), (1, 0), (-2, 0)]
    rows = [("a", i, float(x), float(y), 0) for i, (x, y) in enumerate(tri)] + [("a", 3, 2.0, 0.0, 1)] + [("a", 4 + i, float(x), float(y), 0) for i, (x, y) in enumerate(back)] + [("b", 0, 1.0, 1.0, 0), ("b", 1, 1.0, 1.0, 1)]
    got = {(x.record_id, x.first): x for x in gaze.saccade_shape(spark.createDataFrame(rows, "record_id string, i long, x double, y double, label int"), "label").collect()}
    assert (got["a", 0].deviation, got["a", 0].curvature_area) == pytest.approx((0.5, 1.0)) and got["a", 0].successive_deviation is None
    assert got["a", 0].skewness_exponent == pytest.approx(0)
    assert (got["a", 4].deviation, got["a", 4].curvature_area, got["a", 4].successive_deviation) == pytest.approx((0, 0, 180))
    assert got["a", 4].skewness_exponent < 0  # the faster part comes last
    assert got["b", 0].deviation is None and got["b", 0].skewness_exponent is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1] / max(len(a), len(b), 1)


def clusters(words, k, seed, tries, rounds=30):
    from hashlib import md5

    draw = lambda i, n: md5(f"{i}:{n}".encode()).hexdigest()
    heads = sorted(words, key=lambda i: (draw(i, seed), i))[:k]
    now = {i: min((distance(w, words[m]), m) for m in heads)[1] for i, w in words.items()}
    costs = [sum(distance(w, words[now[i]]) for i, w in words.items())]
    for n in range(1, rounds + 1):
        new = {}
        for m in set(now.values()):
            own = [i for i in words if now[i] == m]
            tried = sorted(own, key=lambda i: (i != m, draw(i, seed + n), i))[: tries + 1]
            new[m] = min(tried, key=lambda c: (round(sum(distance(words[i], words[c]) for i in own), 9), c != m, c))
        after = {i: min((distance(w, words[c]), c != new[now[i]], c) for c in new.values())[2] for i, w in words.items()}
        costs.append(sum(distance(w, words[after[i]]) for i, w in words.items()))
        same = after == now and all(a == b for a, b in new.items())
        now = after
        if same:
            break
    return now, costs


def test_medoids_as_in_plain_python(spark):
    r = random.Random(6)
    seeds = ["aaaabbbb", "cdcdcdcd", "hgfedcba", "bbbb"]
    words = {f"r{i}": "".join(c if r.random() < 0.75 else r.choice("abcdefgh") for c in r.choice(seeds)) for i in range(70)} | {"e": "", "f": "", "g": "aaaabbbb", "h": "aaaabbbb"}
    df = spark.createDataFrame(list(words.items()), "record_id string, word string")
    for k, tries in ((4, 5), (1, 100), (3, 0)):
        want, costs = clusters(words, k, 1, tries)
        got = gaze.word_clusters(df, k, 1, tries).collect()
        assert {x.record_id: x.medoid for x in got} == want
        assert all(x.distance == pytest.approx(distance(words[x.record_id], words[x.medoid])) for x in got)
        assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:], strict=False)) and (k == 3 or costs[-1] < costs[0])


def test_mean_shift_shuffles_a_scanpath_once(spark):
    r = np.random.default_rng(12)
    rows = [(k, s, i, *(float(v) for v in r.normal(size=2) * 30), f"{k}{i}") for k, s, n in ((1, "a", 1), (1, "b", 40), (2, "a", 300), (3, None, 5)) for i in range(n)]
    rows += [(4, "a", 0, float("nan"), 1.0, "n"), (4, "a", 1, float("nan"), 1.0, "m"), (4, "a", 2, 5.0, 1.0, "p"), (4, "a", 3, None, 1.0, "q")]
    df = spark.createDataFrame(rows, "k int, s string, i int, x double, y double, note string").repartition(4)
    out = scanpath.mean_shift(df, ["k", "s"], "i", 25.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    got = {(x.k, x.s, x.i): x for x in out.collect()}
    assert out.columns == [*df.columns, "area"] and all(tuple(x)[:-1] in rows or x.k == 4 for x in got.values())
    assert {k: x.area for k, x in got.items() if k[0] == 4} == {(4, "a", 0): -1, (4, "a", 1): -1, (4, "a", 2): 1}
    for key in ((1, "a"), (1, "b"), (2, "a")):
        p = np.array([q[3:5] for q in rows if q[:2] == key])
        modes, moves = p.copy(), np.ones(len(p), bool)
        for _ in range(50):
            to = np.array([p[((p - m) ** 2).sum(1) <= 625].mean(0) for m in modes])
            far = np.abs(to - modes).max(1) >= 1e-6
            modes[moves] = to[moves]
            moves &= far
        seen = []
        for n, m in enumerate(modes.round(6)):
            hit = [k for k, c in enumerate(seen) if ((c - m) ** 2).sum() <= 625]
            if not hit:
                seen.append(m)
            assert got[(*key, n)].area == (hit[0] if hit else len(seen) - 1), (key, n)

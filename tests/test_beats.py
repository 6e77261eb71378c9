"""R peaks by the fold against plain Python, and against beats placed by hand."""

import math
import random

import numpy as np

from tidegrid.operators import ecg


def decide(c, fs):
    """The rules once more, as a loop over candidates."""
    spki = npki = spkf = npkf = i1 = f1 = f2 = low = high = missed = 0.0
    rr, rr2, found, before = [], [], [], None
    for k, x in enumerate(c):
        now = None
        if k:
            now = (x["p"] - before["p"]) / fs
            rr = (rr + [now])[-8:]
            first = second = math.fsum(rr) / len(rr)
            if k >= 8:
                good = [v for v in rr if low < v < high]
                if good and len(rr2) + len(good) > 8:
                    second = sum((rr2 + good)[-8:]) / 8
                rr2 = (rr2 + good)[-8:]
            if len(rr2) == 8 or k < 8:
                low, high, missed = 0.92 * second, 1.16 * second, 1.66 * second
            if first < low or first > missed:
                i1, f1 = i1 / 2, f1 / 2
            if now > missed and x["bx"] > i1:
                spki = 0.25 * x["bx"] + 0.75 * spki
                i1 = npki + 0.25 * (spki - npki)
                if x["bb"] is not None and x["bb"] > max(f1, f2):
                    spkf = 0.25 * x["bb"] + 0.75 * spkf
                    f1 = npkf + 0.25 * (spkf - npkf)
                    found.append(x["bp"])
        if x["m"] < i1:
            npki, npkf = 0.125 * x["m"] + 0.875 * npki, 0.125 * x["b"] + 0.875 * npkf
        elif k and 0.2 < now < 0.36 and x["slope"] < 0.5 * before["slope"]:
            npki = 0.125 * x["m"] + 0.875 * npki
        else:
            spki = 0.125 * x["m"] + 0.875 * spki
            if x["b"] > f1:
                spkf = 0.125 * x["b"] + 0.875 * spkf
                found.append(x["r"])
            else:
                npkf = 0.125 * x["b"] + 0.875 * npkf
        i1, f1 = npki + 0.25 * (spki - npki), npkf + 0.25 * (spkf - npkf)
        f2, before = 0.5 * f1, x
    return set(found)


def look(g, band, fs):
    """Candidates by loops over samples."""
    n, w, half = len(g), round(0.15 * fs), max(1, round(round(0.15 * fs) / 2))
    sm = [sum(g[max(0, i - 12) : i + 13]) / 25 for i in range(n)]
    ps = [i for i in range(round(0.5 * fs) + 1, n - 1) if sm[i] > sm[i - 1] and sm[i] > sm[i + 1]]
    out, last = [], -1
    for p in ps:
        near = range(max(0, p - w), min(p + w, n - 1))
        r = max(near, key=lambda j: (band[j], -j))
        x = max(range(last + 1, p + 1), key=lambda j: (g[j], -j))
        back = range(max(0, x - w), x)
        bp = max(back, key=lambda j: (band[j], -j), default=None)
        slope = max(g[j] - g[j - 1] for j in range(max(1, p - half + 1), p + 1))
        out.append({"p": p, "m": g[p], "b": band[r], "r": r, "slope": slope, "bx": g[x], "bb": None if bp is None else band[bp], "bp": bp})
        last = p
    return out


def beats(at, fs, seconds, noise=0.0, seed=1, heights=None, t_wave=0.0):
    r = np.random.default_rng(seed)
    n = round(seconds * fs)
    x = noise * r.normal(size=n)
    for k, t in enumerate(at):
        for centre, width, height in ((t, 0.012, heights[k] if heights else 1.0), (t + 0.28, 0.05, t_wave)):
            x += height * np.exp(-(((np.arange(n) / fs - centre) / width) ** 2) / 2)
    return x


def frame(spark, signals):
    return spark.createDataFrame([(k, i, float(v)) for k, s in signals.items() for i, v in enumerate(s)], "record_id long, i long, x double")


def test_fold_equals_the_loop(spark):
    r = random.Random(4)
    signals = {k: [r.gauss(0, 1) for _ in range(r.choice([3, 40, 300, 900]))] for k in range(12)}
    signals[20] = [1.0] * 200
    signals |= {30 + k: beats(np.cumsum([r.uniform(0.25, 2.2) for _ in range(12)]), 50, 20, 0.02, k, [r.uniform(0.1, 2) for _ in range(12)], r.uniform(0, 0.6)) for k in range(12)}
    front = ecg.front_end(frame(spark, signals), "x", 50).cache()
    rows = {}
    for x in front.orderBy("record_id", "i").collect():
        rows.setdefault(x.record_id, []).append((x.integrated, x.band))
    got = {}
    for x in ecg.decided(ecg.candidates(front, 50), 50).collect():
        got.setdefault(x.record_id, set()).add(x.r)
    wanted = {k: decide(look([a for a, _ in v], [b for _, b in v], 50), 50) for k, v in rows.items() if all(b is not None for _, b in v)}
    assert got == {k: v for k, v in wanted.items() if v}
    assert sum(map(len, got.values())) > 100


def test_beats_placed_by_hand(spark):
    fs, even = 250, [0.9 + 0.8 * k for k in range(20)]
    low = [1.0] * 20
    low[12] = 0.45  # its integrated peak, a fifth of the others', is under the thresholds
    signals = {1: beats(even, fs, 17.5, 0.005), 2: beats(even, fs, 17.5, 0.005, 2, low), 3: beats(even, fs, 17.5, 0.005, 3, None, 0.25)}
    got = {}
    for x in ecg.r_peaks(frame(spark, signals), "x", fs).collect():
        got.setdefault(x.record_id, []).append(x.i / fs)
    for k in (1, 2, 3):
        learned = sorted(t for t in got[k] if t > 0.8)  # thresholds are 0 at first, so the first candidate is always one
        true = [t for n, t in enumerate(even) if k != 2 or n != 12]
        assert len(learned) == len(true) and all(abs(a - b) <= 0.012 for a, b in zip(learned, true, strict=True)), (k, learned)


def test_short_constant_and_empty_records(spark):
    signals = {1: [0.5], 2: [0.0] * 400, 3: [0.1, 0.2]}
    assert ecg.r_peaks(frame(spark, signals), "x", 50).collect() == []
    assert ecg.r_peaks(frame(spark, {}), "x", 50).collect() == []

"""Sequential numerical steps, one record or segment at a time, as Arrow-backed grouped kernels.

Each kernel gets one recording (or segment) and gives a few rows; Spark deals
the recordings out. Definitions are those of the published methods.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _grouped(df: DataFrame, key: str, schema: str, one: Callable[[pd.DataFrame], dict | list[dict]]) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = one(pdf)
        out = out if isinstance(out, list) else [out]
        return pd.DataFrame([{key: pdf[key].iloc[0], **x} for x in out], columns=[key, *names])

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def beats(integrated: np.ndarray, band: np.ndarray, fs: float) -> list[int]:
    """Adaptive thresholds on the integrated and the band-passed signal (Pan and Tompkins, 1985).

    Candidates are local maxima 200 ms apart; one above both thresholds is a beat
    and moves the signal levels, another moves the noise levels. After 1.66 mean
    intervals without a beat the best candidate over half the threshold is taken.
    A candidate within 360 ms of a beat with less than half of its slope is a T wave.
    """
    n = len(integrated)
    inner = np.flatnonzero((integrated[1:-1] > integrated[:-2]) & (integrated[1:-1] >= integrated[2:])) + 1 if n > 2 else np.empty(0, int)
    reach = max(1, round(0.15 * fs))
    high = np.array([band[max(0, p - reach) : p + reach + 1].max() for p in inner])
    slope = np.array([np.diff(band[max(0, p - reach) : p + 1]).max(initial=0.0) for p in inner])
    warm = slice(0, max(2, int(2 * fs)))
    levels = [0.25 * integrated[warm].max(initial=0), 0.5 * integrated[warm].mean() if n else 0, 0.25 * band[warm].max(initial=0), 0.5 * np.abs(band[warm]).mean() if n else 0]
    found: list[int] = []  # places in ``inner``
    missed: list[int] = []

    def bound(k: int) -> float:
        return levels[k + 1] + 0.25 * (levels[k] - levels[k + 1])

    def accept(c: int, weight: float) -> None:
        levels[0] += weight * (integrated[inner[c]] - levels[0])
        levels[2] += weight * (high[c] - levels[2])
        found.append(c)

    for c, p in enumerate(inner):
        steps = np.diff(inner[found[-9:]])
        if len(steps) and p - inner[found[-1]] > 1.66 * steps.mean():
            late = [m for m in missed if inner[m] - inner[found[-1]] > 0.36 * fs and integrated[inner[m]] > bound(0) / 2]
            if late:
                accept(max(late, key=lambda m: integrated[inner[m]]), 0.25)
                missed = [m for m in missed if m > found[-1]]
        gap = p - inner[found[-1]] if found else n
        wave = found and gap < 0.36 * fs and slope[c] < 0.5 * slope[found[-1]]
        if gap > 0.2 * fs and not wave and integrated[p] > bound(0) and high[c] > bound(2):
            accept(c, 0.125)
            missed = []
        else:
            levels[1] += 0.125 * (integrated[p] - levels[1])
            levels[3] += 0.125 * (high[c] - levels[3])
            missed.append(c)
    return sorted(int(inner[c]) for c in set(found))


def qrs_peaks(df: DataFrame, fs: float) -> DataFrame:
    """(record_id, i): beats of each record of ``ecg.front_end``'s output."""

    def one(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values("i")
        at = beats(pdf["integrated"].to_numpy(), pdf["band"].to_numpy(), fs)
        return [{"i": int(pdf["i"].iloc[p])} for p in at]

    return _grouped(df.select("record_id", "i", "integrated", "band"), "record_id", "i long", one)


def power_spectrum(x: np.ndarray, rate: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Welch's density with Hann windows that overlap by half."""
    size = min(size, len(x))
    window = np.hanning(size + 1)[:-1] if size > 1 else np.ones(size)
    parts = [x[i : i + size] for i in range(0, len(x) - size + 1, max(1, size // 2))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], 0) / (rate * max((window**2).sum(), 1e-300))
    power[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    return float(p[(f >= low) & (f < high)].sum() * (f[1] - f[0])) if len(f) > 1 else np.nan


def welch(df: DataFrame, x: str, rate: float, key: str = "record_id") -> DataFrame:
    """Total power and the frequency of most power of each record."""

    def one(pdf: pd.DataFrame) -> dict:
        f, p = power_spectrum(pdf.sort_values("i")[x].to_numpy(float), rate)
        return {"power": band_power(f, p, 0, rate), "peak_hz": float(f[p.argmax()])}

    return _grouped(df.select(key, "i", x), key, "power double, peak_hz double", one)


def suppressed(x: np.ndarray, distance: int, share: float) -> np.ndarray:
    """Local maxima by falling height, none nearer than ``distance`` to a higher one, of at least ``share`` of the highest."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1 if len(x) > 2 else np.empty(0, int)
    kept: list[int] = []
    for p in at[np.argsort(-x[at], kind="stable")]:
        if all(abs(p - q) >= distance for q in kept):
            kept.append(int(p))
    top = x[kept].max() if kept else 0
    return np.array(sorted(p for p in kept if x[p] >= share * top), int)


def suppressed_peaks(df: DataFrame, x: str, distance: int, share: float, key: str = "record_id") -> DataFrame:
    def one(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values("i")
        return [{"i": int(pdf["i"].iloc[p])} for p in suppressed(pdf[x].to_numpy(float), distance, share)]

    return _grouped(df.select(key, "i", x), key, "i long", one)


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull by monotone chains."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return 0.0

    def half(q: list) -> list:
        out: list = []
        for a in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (a[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (a[0] - out[-2][0]):
                out.pop()
            out.append(a)
        return out[:-1]

    h = np.array(half(p) + half(p[::-1]))
    return float(abs(h[:, 0] @ np.roll(h[:, 1], -1) - h[:, 1] @ np.roll(h[:, 0], -1)) / 2)


def hulls(df: DataFrame, key: str) -> DataFrame:
    """(key, hull_area): the convex hull of each scanpath."""
    return _grouped(df.select(key, "x", "y"), key, "hull_area double", lambda pdf: {"hull_area": hull_area(pdf[["x", "y"]].to_numpy(float))})

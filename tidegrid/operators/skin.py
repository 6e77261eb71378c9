"""Skin conductance as tonic level, phasic responses and their driver, a row a sample (``record_id``, ``i``, value).

A record is fitted by windows of 120 s that overlap. Of each the first 20 s are kept, and the 20 s
after them, or 40, where the fit is good; the next window starts there, from the tonic level
that was reached. So a record's windows follow each other; a task streams through its records in order
and holds one window at a time, whatever their length.

A window is a sparse sum of unit atoms with non-negative weights: six ramps of the tonic level, and
biexponential responses from each sample of its first 60 s in five time scales. The weights are
those of the positive lasso, along its homotopy path: from the penalty at which all are
zero downwards, the active atoms' weights move so that all stay equally correlated with the rest; an
atom joins when it gets as correlated as they are, and one whose weight falls to zero leaves. The
Cholesky factor of the active atoms' products is updated for each that joins, downdated for each that leaves; its inverse
goes with it, so that an event costs a few products with vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Seconds of a window, of its atoms' onsets, and of the least part that is kept.
SPAN, REACH, STEP = 120, 60, 20
#: Time scales of the responses, and the ends of their rise and decay in seconds.
SCALES, RISE, DECAY, LASTS = (0.5, 0.75, 1.0, 1.25, 1.5), 0.5, 2.0, 10
#: Events on a window's path, and the norm of the rest of its first 20 s that ends it.
EVENTS, CLOSE = 50, 5e-4


def joined(factor: np.ndarray, products: np.ndarray, own: float, inverse: np.ndarray | None = None) -> np.ndarray | None:
    """The lower Cholesky factor with one more row; None for an atom that depends on those before."""
    n = len(factor)
    if not n:
        row = products
    else:
        row = np.linalg.solve(factor, products) if inverse is None else inverse @ products
    left = own - row @ row
    if left <= 1e-9 * own:
        return None
    out = np.zeros((n + 1, n + 1))
    out[:n, :n], out[n, :n], out[n, n] = factor, row, np.sqrt(left)
    return out


def inverted(inverse: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The inverse of a lower factor that has got ``row`` as its last one."""
    n = len(inverse)
    out = np.zeros((n + 1, n + 1))
    out[:n, :n], out[n, :n], out[n, n] = inverse, -(row[:n] @ inverse) / row[n], 1 / row[n]
    return out


def left_out(factor: np.ndarray, k: int) -> np.ndarray:
    """The factor without row ``k``: plane rotations clear what then stands above the diagonal."""
    out = np.delete(factor, k, 0)
    for j in range(k, len(out)):
        a, b = out[j:, j].copy(), out[j:, j + 1].copy()
        r = np.hypot(a[0], b[0])
        out[j:, j], out[j:, j + 1] = (a[0] * a + b[0] * b) / r, (a[0] * b - b[0] * a) / r
    return out[:, :-1]


def path(gram: np.ndarray, along: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """(penalty, weights) at the corners of the positive lasso's path, from all zero to the fit without penalty.

    ``gram`` has the atoms' products with each other, ``along`` those with the signal. At each corner
    no atom's product with the rest is over the penalty, and those of the atoms with weight equal it.
    """
    weights, factor, inverse, active = np.zeros(len(along)), np.zeros((0, 0)), np.zeros((0, 0)), []
    rows = np.empty((16, len(along)))  # the active atoms' products, one after the other
    free = np.ones(len(along), bool)  # neither active nor dependent on those that are
    penalty, gone = float(along.max(initial=0.0)), -1
    if penalty <= 0:
        return
    joins, rest = int(along.argmax()), along.astype(float)  # a copy
    yield penalty, weights.copy()
    while True:
        if joins >= 0:
            free[joins] = False
            more = joined(factor, gram[joins, active], gram[joins, joins], inverse)
            if more is not None:
                factor, inverse = more, inverted(inverse, more[-1])
                if len(active) == len(rows):
                    rows = np.concatenate((rows, np.empty_like(rows)))
                rows[len(active)] = gram[joins]
                active.append(joins)
        if not active:
            return
        pace = inverse.sum(1) @ inverse
        slope = pace @ rows[: len(active)]
        until = np.full(len(along), np.inf)
        np.divide(np.maximum(penalty - rest, 0), 1 - slope, out=until, where=free & (1 - slope > 1e-12))
        if gone >= 0:
            until[gone] = np.inf
        falls = np.full(len(active), np.inf)
        np.divide(-weights[active], pace, out=falls, where=pace < 0)
        step = min(float(until.min()), float(falls.min()), penalty)
        weights[active] += step * pace
        rest -= step * slope
        penalty, joins, gone = penalty - step, -1, -1
        if step == falls.min():
            k = int(falls.argmin())
            gone = active.pop(k)
            weights[gone], factor = 0.0, left_out(factor, k)
            inverse = np.linalg.inv(factor)
            rows[k : len(active)] = rows[k + 1 : len(active) + 1]
            free[:] = True
            free[active] = False
        elif step == until.min():
            joins = int(until.argmin())
        yield penalty, weights.copy()
        if joins < 0 and gone < 0:
            return


@cache
def atoms(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """A window's atoms as columns, the six ramps first, and their products with each other.

    A ramp rises, or falls, from the start of the onsets, from a third or from two thirds of them to
    their end, all to the same slope; they are divided by the norm of the longest one.
    """
    n, reach = round(SPAN * rate), round(REACH * rate)
    ramps = np.zeros((n, 6))
    for third in range(3):
        begin = third * reach // 3
        ramps[begin:reach, 2 * third] = np.linspace(0, 1 - third / 3, reach - begin)
        ramps[:, 2 * third + 1] = -ramps[:, 2 * third]
    columns = [ramps / np.linalg.norm(ramps[:, 0])]
    for scale in SCALES:
        t = np.arange(0, LASTS + 1e-10, 1 / (rate * scale))
        shape = np.exp(-t / DECAY) - np.exp(-t / RISE)
        place = np.arange(n)[:, None] - np.arange(reach)
        inside = (place >= 0) & (place < len(t))
        columns.append(np.where(inside, (shape / np.linalg.norm(shape))[np.clip(place, 0, len(t) - 1)], 0.0))
    out = np.concatenate(columns, 1)
    return out, out.T @ out


@cache
def _begins(rate: float) -> np.ndarray:
    """What each atom, a row, is in a window's first samples."""
    return np.ascontiguousarray(atoms(rate)[0][: round(STEP * rate)].T)


def fitted(y: np.ndarray, rate: float) -> np.ndarray:
    """The weights of a window at the last corner of its path that is looked at."""
    x, gram = atoms(rate)
    begins, weights = _begins(rate), np.zeros(x.shape[1])
    head = y[: begins.shape[1]]
    for k, (_, weights) in enumerate(path(gram, x.T @ y)):
        used = np.flatnonzero(weights)
        left = head - weights[used] @ begins[used]
        if k >= EVENTS or left @ left <= CLOSE**2:
            break
    return weights


class Record:
    """One record on its way through a task: samples in, parts out as soon as their window is full."""

    def __init__(self, rate: float):
        self.rate, self.n, self.reach, self.step = rate, round(SPAN * rate), round(REACH * rate), round(STEP * rate)
        self.wait, self.level, self.head, self.window = np.empty(0), 0.0, self.step, 0

    def push(self, y: np.ndarray) -> Iterator[np.ndarray]:
        if not len(self.wait) and not self.window:
            self.wait, self.level = np.full(self.step, y[0]), float(y[0])  # 20 s of the first value go before
        self.wait = np.concatenate((self.wait, y))
        while len(self.wait) > self.n:  # the last value is kept back: it goes on after the record
            yield self.cut(self.wait[: self.n])

    def end(self) -> Iterator[np.ndarray]:
        while len(self.wait):
            yield self.cut(np.concatenate((self.wait, np.full(self.n, self.wait[-1])))[: self.n])

    def cut(self, part: np.ndarray) -> np.ndarray:
        """(window, tonic, phasic, driver, error) of what is kept of a window, as rows of an array."""
        x, _ = atoms(self.rate)
        weights = fitted(part - self.level, self.rate)
        tonic, phasic = x[:, :6] @ weights[:6] + self.level, x[:, 6:] @ weights[6:]
        error = (part - tonic - phasic) ** 2
        keep = self.step
        for _ in range(2):
            if error[keep : keep + self.step].sum() >= 1:
                break
            keep += self.step
        driver = weights[6:].reshape(len(SCALES), self.reach).sum(0)
        self.level = float(tonic[keep - 1])
        low, high = self.head, min(keep, len(self.wait))
        self.head, self.wait = 0, self.wait[keep:]
        out = np.stack([np.full(keep, float(self.window)), tonic[:keep], phasic[:keep], driver[:keep], error[:keep]])[:, low:high]
        self.window += 1
        return out


def _parts(rate: float, kind: pa.DataType | None = None):
    names = ["record_id", "i", "window", "tonic", "phasic", "driver", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, own, places = None, None, np.empty(0, np.int64)

        def told(key: pa.Scalar, parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal places
            for part in parts:
                n = part.shape[1]
                yield pa.record_batch([pa.array([key.as_py()] * n, key.type), places[:n], part[0].astype(np.int64), *part[1:]], names=names)
                places = places[n:]

        for batch in batches:
            keys = batch.column("record_id")
            number = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(keys)])).tolist()
            place, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "x"))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if own is None or keys[a] != record:
                    if own is not None:
                        yield from told(record, own.end())
                    record, own, places = keys[a], Record(rate), np.empty(0, np.int64)
                places = np.concatenate((places, place[a:b]))
                yield from told(record, own.push(value[a:b]))
        if own is not None:
            yield from told(record, own.end())

    return run


def series(df: DataFrame, x: str, rate: float) -> DataFrame:
    """(record_id, i, window, tonic, phasic, driver, error): tonic and phasic part and driver of each sample, and the squared rest.

    Null and NaN samples are left out, what is left of a record is taken as evenly sampled; null records are left out. A
    record of any length passes, one of few samples too. Fitting is what takes time, not the bytes of the samples, so
    records are dealt to as many tasks as a shuffle has.
    """
    own = df.select("record_id", F.col("i").cast("long").alias("i"), F.col(x).cast("double").alias("x")).where("record_id IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    rows = own.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "record_id").sortWithinPartitions("record_id", "i")
    return rows.mapInArrow(_parts(rate), f"record_id {dict(df.dtypes)['record_id']}, i long, window long, tonic double, phasic double, driver double, error double")


def events(parts: DataFrame, distance: int, share: float = 0.005) -> DataFrame:
    """(record_id, i, driver): a driver's samples by falling height, each ``distance`` from higher ones at least, of at least ``share`` of the record's highest.

    Samples only compete within a chain of positive ones nearer than ``distance``, so each chain is decided for itself; of equal ones the first stays.
    """
    w = Window.partitionBy("record_id").orderBy("i")
    own = parts.where("driver > 0").select("record_id", "i", "driver")
    far = F.coalesce(F.col("i") - F.lag("i").over(w) >= distance, F.lit(True)).cast("int")
    chain = own.withColumn("_far", far).withColumn("_c", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = chain.withColumn("_top", F.max("driver").over(Window.partitionBy("record_id")))
    each = chain.groupBy("record_id", "_c").agg(F.max("_top").alias("_top"), F.sort_array(F.collect_list(F.struct((-F.col("driver")).alias("d"), "i"))).alias("s"))
    none = F.array().cast("array<struct<d:double,i:bigint>>")
    kept = F.aggregate("s", none, lambda k, p: F.when(F.forall(k, lambda q: F.abs(q["i"] - p["i"]) >= distance), F.concat(k, F.array(p))).otherwise(k))
    out = each.select("record_id", "_top", F.explode(kept).alias("k")).select("record_id", F.col("k.i").alias("i"), (-F.col("k.d")).alias("driver"), "_top")
    return out.where(F.col("driver") >= share * F.col("_top")).drop("_top")


def scaled(parts: DataFrame, share: float = 0.995) -> DataFrame:
    """Adds ``scr``, the phasic part over its quantile in the record (null where that is 0). ``parts`` are written, so that they are fitted once."""
    parts = written(parts, "skin", free=False)
    top = parts.groupBy("record_id").agg(F.percentile("phasic", share).alias("_q"))
    return parts.join(top, "record_id").withColumn("scr", F.try_divide("phasic", "_q")).drop("_q")


def windows(parts: DataFrame) -> DataFrame:
    """(record_id, window, first, n, mse): the mean squared rest of what was kept of each window."""
    return parts.groupBy("record_id", "window").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.avg("error").alias("mse"))


def event_rates(parts: DataFrame, found: DataFrame, rate: float) -> DataFrame:
    """(record_id, block, frequency): events a second in each 120 s of a record, the last part block too if it is full."""
    n = round(SPAN * rate)
    full = parts.groupBy("record_id", F.expr(f"i div {n}").alias("block")).agg(F.count("*").alias("_n")).where(f"_n = {n}")
    own = found.groupBy("record_id", F.expr(f"i div {n}").alias("block")).agg(F.count("*").alias("_e"))
    return full.join(own, ["record_id", "block"], "left").select("record_id", "block", (F.coalesce("_e", F.lit(0)) / (n / rate)).alias("frequency"))


def totals(df: DataFrame, x: str, rate: float) -> DataFrame:
    """(record_id, tonic, n_events, driver, mse): mean tonic level, driver events a second apart, sum of the driver, mean squared rest."""
    parts = written(series(df, x, rate), "skin", free=False)  # both its events and its sums are looked at
    found = events(parts, max(1, round(rate))).groupBy("record_id").agg(F.count("*").alias("n_events"))
    each = parts.groupBy("record_id").agg(F.avg("tonic").alias("tonic"), F.sum("driver").alias("driver"), F.avg("error").alias("mse"))
    return each.join(found, "record_id", "left").select("record_id", "tonic", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), "driver", "mse")

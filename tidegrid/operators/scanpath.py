"""Scanpaths: order along a Hilbert curve, fractal dimension, areas of interest by mean shift, complexity of their sequence.

A scanpath is what one segment of a record holds (some dozens of fixations), named by ``keys``; all joins and groups are within it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def hilbert(x: Column, y: Column, iterations: int = 4) -> Column:
    """Place on the Hilbert curve of a cell (x, y) of a square of ``2**iterations`` cells a side, both counted from 0.

    One bit of both coordinates a step, the highest first: they tell the quarter, and how the curve is turned in it.
    """
    side = 1 << iterations
    start = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(0).alias("d"))

    def step(s: Column, bit: Column) -> Column:
        right, top = s["x"].bitwiseAND(bit) > 0, s["y"].bitwiseAND(bit) > 0
        quarter = F.when(right, F.when(top, 2).otherwise(3)).otherwise(F.when(top, 1).otherwise(0))
        flip = lambda c: F.when(right & ~top, side - 1 - c).otherwise(c)
        turned = lambda a, b: F.when(top, a).otherwise(flip(b))
        return F.struct(turned(s["x"], s["y"]).alias("x"), turned(s["y"], s["x"]).alias("y"), (s["d"] + bit * bit * quarter).alias("d"))

    return F.aggregate(F.array(*[F.lit(side >> k + 1) for k in range(iterations)]), start, step, lambda s: s["d"])


def on_grid(value: Column, low: float, high: float, iterations: int = 4) -> Column:
    """The cell of a coordinate, of ``2**iterations`` between ``low`` and ``high``; what is outside belongs to the outermost ones."""
    cells = 1 << iterations
    return F.least(F.greatest(F.floor((value - low) / (high - low) * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def higuchi(df: DataFrame, keys: Sequence[str], value: str, order: str, kmax: int = 10) -> DataFrame:
    """(keys, fractal_dimension): Higuchi's (1988), from the lengths of a sequence at steps of 1 to ``kmax``.

    A step counts if it fits in twice; null where fewer than two do.
    """
    w, s = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    far = lambda k: F.struct(F.lit(k).alias("k"), F.abs(F.col(value) - F.lag(value, k).over(w)).alias("d"))
    own = df.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(s).alias("n"), F.array(*[far(k) for k in range(1, kmax + 1)]).alias("f"))
    steps = own.select(*keys, "i", "n", F.inline("f")).where("d IS NOT NULL AND n > 2 * k").withColumn("m", F.expr("i % k"))
    each = steps.groupBy(*keys, "n", "k", "m").agg(F.sum("d").alias("d"))
    length = each.withColumn("l", F.col("d") * (F.col("n") - 1) / (F.expr("((n - 1 - m) div k) * k") * F.col("k")))
    at = length.groupBy(*keys, "k").agg(F.log(F.avg("l") + 1e-300).alias("l"))
    out = at.groupBy(*keys).agg(F.regr_slope("l", -F.log(F.col("k").cast("double"))).alias("fractal_dimension"))
    return df.select(*keys).distinct().join(out, list(keys), "left")


def shifted(at: np.ndarray, x: np.ndarray, y: np.ndarray, bandwidth: float, rounds: int, still: float, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Where the points of some scanpaths, each from one of ``at`` to the next, have moved to; ``cells`` pairs of a point and another are looked at together."""
    owner, many = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.diff(at)
    mx, my, moving = x.copy(), y.copy(), np.arange(len(x))
    for _ in range(rounds):
        ends, low = np.cumsum(many[owner[moving]]), 0
        nx, ny = np.empty((2, len(moving)))
        while low < len(moving):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + cells, "right")))
            here = moving[low:high]
            count = many[owner[here]]
            one = np.repeat(np.arange(len(here)), count)
            two = np.repeat(at[owner[here]] - (np.cumsum(count) - count), count) + np.arange(len(one))
            with np.errstate(invalid="ignore"):
                near = np.repeat(mx[here], count) - x[two]
                near = near * near + (np.repeat(my[here], count) - y[two]) ** 2 <= bandwidth**2
                one, two = one[near], two[near]
                met = np.bincount(one, minlength=len(here))
                nx[low:high], ny[low:high] = np.bincount(one, x[two], len(here)) / met, np.bincount(one, y[two], len(here)) / met
            low = high
        on = ~np.isnan(nx)  # a point that is nowhere meets none, not even itself
        moving, nx, ny = moving[on], nx[on], ny[on]
        far = np.maximum(np.abs(nx - mx[moving]), np.abs(ny - my[moving])) >= still
        mx[moving], my[moving] = nx, ny
        moving = moving[far]
        if not len(moving):
            break
    return mx, my


def areas(first: Sequence, mx: Sequence[float], my: Sequence[float], bandwidth: float) -> list[int]:
    """The area of each point of one scanpath, from its place in the order and its mode; -1 if that is nowhere."""
    order = sorted(range(len(first)), key=lambda k: (first[k], mx[k], my[k]))
    seen: list[tuple[float, float]] = []
    of: dict[tuple[float, float], int] = {}
    for k in order:
        a, b = mode = mx[k], my[k]
        if mode not in of:
            of[mode] = next((n for n, (u, v) in enumerate(seen) if (u - a) ** 2 + (v - b) ** 2 <= bandwidth**2), len(seen))
            if of[mode] == len(seen):
                seen.append(mode)
                if a != a or b != b:
                    of[mode] = -1
    return [of[m] for m in zip(mx, my, strict=True)]


def mean_shift(df: DataFrame, keys: Sequence[str], order: str, bandwidth: float, rounds: int = 50, still: float = 1e-6) -> DataFrame:
    """``df`` with ``area``, the area of interest of each point (x, y), from 0 in the order of their first points.

    Each point moves to the mean of all points within ``bandwidth`` (a flat kernel), until it moves by less than ``still``, or
    ``rounds`` times. Of the modes, in the order of their first points, one within the bandwidth of an area's belongs to it, the first
    such one; another is a new area's. A scanpath is shuffled once, as an array, and decided in its task; points without a key or a place are left out.
    """
    keys = list(keys)
    own = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "x", "y"))).groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c) for c in df.columns if c not in keys])).alias("_p"))
    columns, names = df.columns, [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.diff(np.asarray(batch.column("_p").offsets).astype(np.int64))
            work, low = np.cumsum(many**2), 0
            while low < len(many):
                high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + (1 << 21), "right")))
                part = batch.slice(low, high - low)
                at = np.concatenate(([0], np.cumsum(many[low:high])))
                fields = dict(zip(names, part.column("_p").flatten().flatten(), strict=True))
                x, y = (fields[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
                mx, my = ([v if v == v else math.nan for v in np.round(m, 6).tolist()] for m in shifted(at, x, y, bandwidth, rounds, still))
                first = pc.rank(fields[order], tiebreaker="dense").to_numpy().tolist()
                told = [areas(first[a:b], mx[a:b], my[a:b], bandwidth) for a, b in pairwise(at.tolist())]
                owner = pa.array(np.repeat(np.arange(high - low), many[low:high]))
                fields |= {k: part.column(k).take(owner) for k in keys} | {"area": pa.array(list(chain.from_iterable(told)), pa.int64())}
                yield pa.record_batch([fields[c] for c in (*columns, "area")], names=[*columns, "area"])
                low = high

    return own.mapInArrow(run, StructType([*df.schema.fields, StructField("area", LongType())]))


def phrases(symbols: Sequence) -> int:
    """Phrases of the parsing of Lempel and Ziv (1976): each is as short as makes it new, where copies may overlap it.

    The sequence's suffix automaton tells where each of its parts ends first; a phrase is followed in it as
    long as the part has begun before, so the whole takes time in proportion to the length.
    """
    follow, link, length, ends = [{}], [-1], [0], [-1]
    last = 0
    for n, c in enumerate(symbols):
        now, state = len(follow), last
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(n)
        while state >= 0 and c not in follow[state]:
            follow[state][c] = now
            state = link[state]
        if state >= 0:
            after = follow[state][c]
            if length[after] == length[state] + 1:
                link[now] = after
            else:
                copy = len(follow)
                follow.append(dict(follow[after]))
                link.append(link[after])
                length.append(length[state] + 1)
                ends.append(ends[after])
                while state >= 0 and follow[state].get(c) == after:
                    follow[state][c] = copy
                    state = link[state]
                link[after] = link[now] = copy
        last = now
    count, begin, n = 0, 0, len(symbols)
    while begin < n:
        size, state = 0, 0
        while begin + size < n:
            state = follow[state][symbols[begin + size]]
            size += 1
            if ends[state] >= begin + size - 1:  # its first end is this one, so it is new
                break
        count, begin = count + 1, begin + size
    return count


def lempel_ziv(df: DataFrame, keys: Sequence[str], symbol: str, order: str) -> DataFrame:
    """(keys, lempel_ziv): the number of phrases of each sequence."""
    own = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, symbol))), lambda s: s[symbol]).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array([phrases(s) for s in batch.column("s").to_pylist()], pa.int64())
            yield pa.record_batch([*(batch.column(k) for k in keys), told], names=[*keys, "lempel_ziv"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", lempel_ziv long")

"""Variability of intervals between beats by segments of some minutes: entropy, detrended fluctuation, band powers.

All is in DataFrame operations grouped by record and segment; what a segment can hold (some hundred
intervals in five minutes) bounds each group. Inputs are rows (record_id, segment, k, nn): k counts the
intervals of a segment from 0, nn is in milliseconds.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["record_id", "segment"]


def by_minutes(nn: DataFrame, order: str, minutes: float = 5) -> DataFrame:
    """(record_id, segment, k, nn): intervals of a record, in order, cut where their sum passes a multiple of ``minutes``."""
    w = Window.partitionBy("record_id").orderBy(order)
    t = F.sum("nn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cut = nn.select("record_id", order, F.col("nn").cast("double").alias("nn")).withColumn("segment", F.floor(t / (minutes * 60000)))
    return cut.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy(order)) - 1).select(*KEYS, "k", "nn")


def approximate_entropy(nn: DataFrame, share: float = 0.2) -> DataFrame:
    """(record_id, segment, apen): Pincus (1991) with runs of two and three intervals, self-matches counted, within ``share`` population SDs.

    Intervals are dealt to cells as wide as the tolerance, so runs only meet others of their own and the two cells beside it.
    """
    w, s = Window.partitionBy(*KEYS).orderBy("k"), Window.partitionBy(*KEYS)
    runs = nn.select(*KEYS, "k", F.col("nn").alias("a"), F.lead("nn").over(w).alias("b"), F.lead("nn", 2).over(w).alias("c"), (share * F.stddev_pop("nn").over(s)).alias("r"))
    cell = F.when(F.col("r") > 0, F.floor(F.col("a") / (F.col("r") * 1.001))).otherwise(F.lit(0)).cast("long")
    runs = runs.where("b IS NOT NULL").withColumn("cell", cell)
    one = runs.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    two = runs.select(*KEYS, "cell", F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    near = (F.abs(F.col("a") - F.col("x")) <= F.col("r")) & (F.abs(F.col("b") - F.col("y")) <= F.col("r"))
    more = F.coalesce(F.abs(F.col("c") - F.col("z")) <= F.col("r"), F.lit(False))
    met = one.join(two, [*KEYS, "cell"]).where(near).groupBy(*KEYS, "k").agg(F.count("*").alias("two"), F.sum(more.cast("long")).alias("three"), F.max((F.col("c").isNotNull()).cast("int")).alias("full"))
    n2, n3 = F.count("*"), F.sum("full")
    phi = lambda c, n: F.sum(F.when(F.col(c) > 0, F.log(c))) / n - F.log(n)
    return met.groupBy(*KEYS).agg(F.when(n3 > 0, phi("two", n2) - phi("three", n3)).alias("apen"))


def fluctuations(nn: DataFrame, ranges: Mapping[str, tuple[int, int]] = {"alpha1": (4, 16), "alpha2": (17, 64)}) -> DataFrame:  # noqa: B006
    """(record_id, segment, alpha1, alpha2): slopes of detrended fluctuation over box sizes (Peng, 1994).

    The running sum of the intervals less their mean is cut into full boxes of each size and fitted by a line in each; null where fewer than two sizes fit.
    """
    w, s = Window.partitionBy(*KEYS).orderBy("k"), Window.partitionBy(*KEYS)
    own = nn.withColumns({"_d": F.col("nn") - F.avg("nn").over(s), "_n": F.count("*").over(s)})
    own = own.withColumn("y", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = min(a for a, _ in ranges.values()), max(b for _, b in ranges.values())
    boxes = own.where(F.col("_n") >= low).select(*KEYS, "k", "y", "_n", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("_n").cast("int")))).alias("size")).withColumn("box", F.expr("k div size"))
    rest = F.regr_syy("y", "k") - F.regr_sxy("y", "k") * F.regr_sxy("y", "k") / F.regr_sxx("y", "k")
    each = boxes.where("(box + 1) * size <= _n").groupBy(*KEYS, "size", "box").agg(F.greatest(rest, F.lit(0.0)).alias("sse"))
    sizes = each.groupBy(*KEYS, "size").agg((0.5 * F.log(F.sum("sse") / (F.count("*") * F.col("size")) + 1e-300)).alias("f"))
    slope = lambda a, b: F.regr_slope(F.when(F.col("size").between(a, b), F.col("f")), F.log(F.col("size").cast("double")))
    out = sizes.groupBy(*KEYS).agg(*[slope(a, b).alias(name) for name, (a, b) in ranges.items()])
    return nn.select(*KEYS).distinct().join(out, KEYS, "left")


def evenly(nn: DataFrame, rate: int = 4) -> DataFrame:
    """(record_id, segment, g, y): a segment's intervals at their ends, linearly interpolated at ``rate`` a second from the first one on."""
    w, step = Window.partitionBy(*KEYS).orderBy("k"), 1_000_000 // rate
    t = F.bround(F.sum(F.when(F.col("k") > 0, F.col("nn")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) * 1000).cast("long")
    at = nn.withColumn("t", t).select(*KEYS, "t", "nn", F.lag("t").over(w).alias("t0"), F.lag("nn").over(w).alias("y0"))
    first, last = F.coalesce(F.expr(f"t0 div {step} + 1"), F.lit(0)), F.expr(f"t div {step}")
    places = at.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("g"))
    y = F.when(F.col("t0").isNull(), F.col("nn")).otherwise(F.col("y0") + (F.col("nn") - F.col("y0")) * ((F.col("g") * step - F.col("t0")) / (F.col("t") - F.col("t0"))))
    return places.select(*KEYS, "g", y.alias("y"))


def band_powers(nn: DataFrame, rate: int = 4, size: int = 256) -> DataFrame:
    """(record_id, segment, lf, hf, ratio): power from 0.04 to 0.15 and from 0.15 to 0.4 Hz, by Welch's method.

    The evenly sampled intervals are cut into windows of ``size`` samples (all of a shorter segment) that overlap by half,
    freed of their mean and tapered (Hann); only the frequencies of both bands are looked at. A band is null, or the segment left out, where it is too short for any of them.
    """
    s = Window.partitionBy(*KEYS)
    own = evenly(nn, rate).withColumns({"y": F.col("y") - F.avg("y").over(s), "n": F.count("*").over(s)}).where("n > 2")
    own = own.withColumn("size", F.least("n", F.lit(size))).withColumn("hop", F.expr("size div 2"))
    first, last = F.greatest(F.expr("(g - size + hop) div hop"), F.lit(0)), F.least(F.expr("g div hop"), F.expr("(n - size) div hop"))
    parts = own.where(first <= last).select(*KEYS, "g", "y", "size", "hop", F.explode(F.sequence(first, last)).alias("window"))
    j = F.col("g") - F.col("window") * F.col("hop")
    parts = parts.withColumn("h", 0.5 - 0.5 * F.cos(2 * F.pi() * j / F.col("size"))).withColumn("j", j)
    bins = F.sequence(F.expr(f"(size * 4 + {rate * 100 - 1}) div {rate * 100}"), F.expr(f"(size * 40 + {rate * 100 - 1}) div {rate * 100} - 1"))
    each = parts.where(F.expr(f"(size * 4 + {rate * 100 - 1}) div {rate * 100} < (size * 40 + {rate * 100 - 1}) div {rate * 100}")).select(*KEYS, "window", "size", "y", "h", "j", F.explode(bins).alias("bin"))
    turn = 2 * F.pi() * F.col("j") * F.col("bin") / F.col("size")
    sums = each.groupBy(*KEYS, "window", "size", "bin").agg(
        F.avg("y").alias("mean"), F.sum(F.col("y") * F.col("h") * F.cos(turn)).alias("yc"), F.sum(F.col("y") * F.col("h") * F.sin(turn)).alias("ys"),
        F.sum(F.col("h") * F.cos(turn)).alias("hc"), F.sum(F.col("h") * F.sin(turn)).alias("hs"), F.sum(F.col("h") * F.col("h")).alias("hh"),
    )
    re, im = F.col("yc") - F.col("mean") * F.col("hc"), F.col("ys") - F.col("mean") * F.col("hs")
    power = sums.select(*KEYS, "size", "bin", (2 * (re * re + im * im) / (rate * F.col("hh"))).alias("p")).groupBy(*KEYS, "size", "bin").agg((F.avg("p") * rate / F.col("size")).alias("p"))
    low = F.col("bin") * (100 * rate) < F.col("size") * 15
    out = power.groupBy(*KEYS).agg(F.sum(F.when(low, F.col("p"))).alias("lf"), F.sum(F.when(~low, F.col("p"))).alias("hf"))
    return out.withColumn("ratio", F.try_divide("lf", "hf"))


def nonlinear(nn: DataFrame) -> DataFrame:
    """(record_id, segment, n, apen, alpha1, alpha2, lf, hf, ratio): a row for each segment, null where one is too short."""
    counted = nn.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return reduce(lambda a, b: a.join(b, KEYS, "left"), [counted, approximate_entropy(nn), fluctuations(nn), band_powers(nn)])

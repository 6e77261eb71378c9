"""Segment features and summaries: skin conductance, gaze geometry, areas of interest, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import quantiles


def moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Mean, biased skewness and excess kurtosis."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))


def morphology(df: DataFrame, keys: Sequence[str], x: str, order: str) -> DataFrame:
    """Perimeter, integral, normalised power, RMS, activity, Hjorth mobility and complexity."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(w)).withColumn("_e", F.col("_d") - F.lag("_d").over(w))
    v = d.groupBy(*keys).agg(
        F.avg(F.sqrt(1 + F.col("_d") * F.col("_d"))).alias("perimeter"), F.avg(F.abs(x)).alias("integral"), F.avg(F.col(x) * F.col(x)).alias("power"),
        F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.var_pop(x).alias("activity"), F.var_pop("_d").alias("_v1"), F.var_pop("_e").alias("_v2"),
    )
    mobility = F.sqrt(F.try_divide("_v1", "activity"))
    return v.withColumns({"mobility": mobility, "complexity": F.try_divide(F.sqrt(F.try_divide("_v2", "_v1")), mobility)}).drop("_v1", "_v2")


def eda_flags(eda: Column, slope: Column, temperature: Column) -> Column:
    """1 where conductance, its slope or temperature is out of range."""
    good = eda.between(0.02, 60) & (F.abs(slope) <= 10) & temperature.between(25, 40)
    return F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)


def bcea_of(x: str, y: str, p: float = 0.68) -> Column:
    """Bivariate contour ellipse area that holds the share ``p`` of a normal distribution, as an aggregate."""
    r = F.coalesce(F.corr(x, y), F.lit(0.0))
    return 2 * -F.log(F.lit(1 - p)) * F.lit(3.141592653589793) * F.stddev_pop(x) * F.stddev_pop(y) * F.sqrt(F.greatest(1 - r * r, F.lit(0.0)))


def bcea(keys: Sequence[str], df: DataFrame, x: str, y: str, p: float = 0.68) -> DataFrame:
    return df.groupBy(*keys).agg(bcea_of(x, y, p).alias("bcea"))


def path_length(df: DataFrame, keys: Sequence[str], x: str, y: str, order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return df.withColumn("_s", step).groupBy(*keys).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("path_length"), F.max("_s").alias("longest_step"))


def recurrence_rate(df: DataFrame, key: str, x: str, y: str, order: str, radius: float) -> DataFrame:
    """Share of pairs of fixations of one scanpath (some dozens) that lie within ``radius``."""
    a = df.select(key, F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))
    b = a.select(key, F.col("o").alias("o2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = (F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)) <= radius).cast("int")
    return a.join(b, key).where("o < o2").groupBy(key).agg(F.avg(near).alias("recurrence"))


def transition_entropies(df: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """exp of the entropy of states and of pairs of successive states."""
    pair = df.withColumn("_p", F.lag(state).over(Window.partitionBy(key).orderBy(order)))

    def entropy(counted: DataFrame, name: str) -> DataFrame:
        p = F.col("c") / F.sum("c").over(Window.partitionBy(key))
        return counted.withColumn("p", p).groupBy(key).agg(F.exp(-F.sum(F.col("p") * F.log("p"))).alias(name))

    one = entropy(df.groupBy(key, state).agg(F.count("*").alias("c")), "stationary")
    two = entropy(pair.where("_p IS NOT NULL").groupBy(key, "_p", state).agg(F.count("*").alias("c")), "joint")
    return one.join(two, key, "left")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of the values in ``bins`` equal bins over [low, high], the upper end in the last one."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("long")
    counted = df.where(F.col(x).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a bin


def quartiles(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """The five numbers of each group, exact; no task sees a whole group."""
    at = quantiles(df, keys, x, (0.25, 0.5, 0.75))
    q = lambda p, name: F.max(F.when(F.col("share") == p, F.col("value"))).alias(name)
    ends = df.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    return ends.join(at.groupBy(*keys).agg(q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3")), list(keys), "left").select(*keys, "low", "q1", "median", "q3", "high")


def annotator_distance(a: DataFrame, b: DataFrame, key: str, width: float = 600, height: float = 450, limit: float = 0.06) -> DataFrame:
    """Mean distance of two annotators to the machine's point over the diagonal; those under ``limit``, mean and SD."""
    diagonal = (width**2 + height**2) ** 0.5
    d = lambda s: F.sqrt(F.pow(F.col(f"{s}.x") - F.col(f"{s}.mx"), 2) + F.pow(F.col(f"{s}.y") - F.col(f"{s}.my"), 2)) / diagonal
    both = a.alias("a").join(b.alias("b"), key)
    return both.select(key, ((d("a") + d("b")) / 2).alias("distance")).where(F.col("distance") < limit).agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"))


def annotation_distances(a: DataFrame, b: DataFrame, width: float = 600, height: float = 450, limit: float = 0.06) -> DataFrame:
    """(record, frame, both, distance) of two annotators' points (record, frame, x, y, mx, my), over the image's diagonal and under ``limit``.

    Only frames whose machine point (mx, my) is strictly inside the image count. Where both saw the same frames of a record, distances are
    the mean of both; where they did not, the second one's alone. A record is some dozens of frames.
    """
    diagonal = (width**2 + height**2) ** 0.5
    each = [d.select("record", "frame", F.struct("x", "y", "mx", "my").alias(n)) for d, n in ((a, "a"), (b, "b"))]
    met = each[0].join(each[1], ["record", "frame"], "full_outer")
    same = F.min((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")).over(Window.partitionBy("record")) == 1
    far = lambda s: F.sqrt(F.pow(F.col(f"{s}.x") - F.col("b.mx"), 2) + F.pow(F.col(f"{s}.y") - F.col("b.my"), 2))
    inside = (F.col("b.mx") > 0) & (F.col("b.mx") < width) & (F.col("b.my") > 0) & (F.col("b.my") < height)
    out = met.withColumn("both", same).where(F.col("b").isNotNull() & inside)
    return out.select("record", "frame", "both", (F.when(F.col("both"), (far("a") + far("b")) / 2).otherwise(far("b")) / diagonal).alias("distance")).where(F.col("distance") < limit)


def is_normalised(df: DataFrame, keys: Sequence[str], x: str, share: float = 0.95) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.avg(F.col(x).between(0, 1).cast("int")), F.lit(0.0)) >= share).alias("normalised"))

"""Signal quality: data checks, the composed decisions on heart and skin signals, and intervals without invalid ends."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ecg, features, series


def between_closed(df: DataFrame, bounds: DataFrame, key: str = "record_id", time: str = "ts_ns") -> DataFrame:
    """Rows with ``start_ns <= time <= end_ns`` of their record's row in ``bounds``."""
    return df.join(bounds.select(key, "start_ns", "end_ns"), key).where(F.col(time).between(F.col("start_ns"), F.col("end_ns"))).drop("start_ns", "end_ns")


def after_until(df: DataFrame, bounds: DataFrame, key: str = "record_id", time: str = "ts_ns") -> DataFrame:
    """Rows with ``start_ns < time <= end_ns`` of their record's row in ``bounds``."""
    inside = (F.col(time) > F.col("start_ns")) & (F.col(time) <= F.col("end_ns"))
    return df.join(bounds.select(key, "start_ns", "end_ns"), key).where(inside).drop("start_ns", "end_ns")


def null_shares(df: DataFrame, columns: Sequence[str], limit: float = 0.01, key: str = "record_id") -> DataFrame:
    """(key, column, share, ok): the share of nulls of each column in each record, and whether it is under ``limit``."""
    shares = df.groupBy(key).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return shares.unpivot(key, list(columns), "column", "share").withColumn("ok", F.col("share") < limit)


def span_overlaps(left: DataFrame, right: DataFrame, key: str = "record_id", time: str = "ts_ns") -> DataFrame:
    """(key, overlap_ns, ok): by how much the time spans of two sensors overlap in each record; 0 where one is missing."""
    a = left.groupBy(key).agg(F.min(time).alias("a0"), F.max(time).alias("a1"))
    b = right.groupBy(key).agg(F.min(time).alias("b0"), F.max(time).alias("b1"))
    overlap = F.greatest(F.coalesce(F.least("a1", "b1") - F.greatest("a0", "b0"), F.lit(0)), F.lit(0)).cast("long")
    missing = F.col("a0").isNull() | F.col("b0").isNull()
    return a.join(b, key, "full_outer").select(key, F.when(missing, F.lit(0).cast("long")).otherwise(overlap).alias("overlap_ns")).withColumn("ok", F.col("overlap_ns") > 0)


def required(df: DataFrame, ok: str | Column, message: str) -> DataFrame:
    """``df`` as it is, if all rows fulfil ``ok``; else the job fails with ``message``."""
    return df.where(F.assert_true(F.coalesce(F.expr(ok) if isinstance(ok, str) else ok, F.lit(False)), F.lit(message)).isNull())


def keys_equal(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """(by, only_left, only_right, equal): how two key sets differ in each group."""
    a, b = left.select(by, key).distinct().withColumn("l", F.lit(1)), right.select(by, key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, [by, key], "full_outer")
    out = both.groupBy(by).agg(F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def without_places(df: DataFrame, places: DataFrame, place: str = "i", key: str = "record_id") -> DataFrame:
    """Rows whose place is not listed for their record."""
    return df.join(places.select(key, place).distinct(), [key, place], "left_anti")


def event_rate(df: DataFrame, flag: str, rate: float, key: str = "record_id") -> DataFrame:
    """Runs of samples with ``flag`` 1 a second, from ``rate`` samples a second."""
    runs = series.islands(df, flag, drop_last=False).groupBy(key).agg(F.count("*").alias("runs"))
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.join(runs, key, "left").select(key, (F.coalesce("runs", F.lit(0)) / (F.col("n") / rate)).alias("rate"))


def as_of_or_last(left: DataFrame, right: DataFrame, value: str, key: str = "record_id") -> DataFrame:
    """The first ``value`` strictly after each row, the record's last one if there is none; a record's last row takes the last one."""
    found = series.as_of(left, right, value, "forward", strict=True)
    last = right.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, "ts_ns").alias("_last"))
    ends = F.lead("ts_ns").over(series.by(key)).isNull()
    out = found.withColumn("_end", ends).join(last, key, "left")
    return out.withColumn(value, F.when(F.col("_end"), F.col("_last")).otherwise(F.coalesce(value, "_last"))).drop("_end", "_last")


def skin_quality(eda: DataFrame, temperature: DataFrame, reach: int = 20, step: float = 1e9) -> DataFrame:
    """status 1 of samples (record_id, ts_ns, eda) without a bad one within ``reach`` rows: conductance 0.02 to 60, slope to 10 a
    second (``step`` nanoseconds), temperature (the next one in time) 25 to 40."""
    both = as_of_or_last(eda.select("record_id", "ts_ns", "eda"), temperature, "temperature")
    sloped = series.gradient(both, "eda", F.col("ts_ns") / step)
    bad = sloped.withColumn("_bad", features.eda_flags(F.col("eda"), F.coalesce("slope", F.lit(0.0)), F.col("temperature")))
    return series.dilate(bad, "_bad", reach, "_near").select("record_id", "ts_ns", "eda", "slope", "temperature", (1 - F.col("_near")).alias("status"))


def heart_quality(df: DataFrame, peaks: DataFrame, x: str, fs: float, width: int = 300, hop: int = 50, flat_step: float = 1.0, most_crossings: int = 200, rates: tuple[float, float] = (24, 240), most_amplitude: float = 1500, least_score: float = 0.5) -> DataFrame:
    """The decision on each window of heart signal (``record_id``, ``i``, x) with the R peaks found in it.

    flat (over 80 % of some ``width`` samples in a row step less than ``flat_step``
    thousandths of the range; a constant window is flat), crossings of the middle of the range,
    heart rate, highest peak, and the mean correlation of all beats, each half an
    interval (the lower of mean and median) around its peak. As the mean of all
    correlations is the squared length of the mean standardised beat, no pairs are
    made. Null figures (no two peaks, a constant beat) are not acceptable.
    """
    ends = Window.partitionBy("record_id")
    low, high = F.min(x).over(ends), F.max(x).over(ends)
    scaled = df.select("record_id", F.col("i").alias("ts_ns"), "i", F.col(x).alias("x"), F.when(high > low, (F.col(x) - low) / (high - low)).alias("s"))
    figures = series.flat_checks(scaled.withColumn("s", F.coalesce(F.col("s") * 1000, F.lit(0.0))), "s", width, hop, flat_step).groupBy("record_id").agg(F.max("share").alias("flat_share"))
    crossed = series.zero_crossings(scaled.withColumn("s", F.coalesce("s", F.lit(0.5)) - 0.5), "s")
    w = Window.partitionBy("record_id").orderBy("i")
    steps = peaks.select("record_id", "i").withColumn("_d", F.col("i") - F.lag("i").over(w))
    beat = steps.groupBy("record_id").agg(F.avg("_d").alias("mean"), F.median("_d").alias("median"))
    beat = beat.select("record_id", (60 * fs / F.col("mean")).alias("heart_rate"), F.bround(F.least("mean", "median") / 2).cast("int").alias("half"))
    tops = scaled.join(peaks.select("record_id", "i"), ["record_id", "i"]).groupBy("record_id").agg(F.max("x").alias("amplitude"))
    around = peaks.join(beat.select("record_id", "half"), "record_id").where("half > 0").select("record_id", F.col("i").alias("beat"), "half", F.explode(F.sequence(-F.col("half"), F.col("half"))).alias("o"))
    part = around.withColumn("i", F.col("beat") + F.col("o")).join(scaled.select("record_id", "i", "x"), ["record_id", "i"])
    b = Window.partitionBy("record_id", "beat")
    z = (F.col("x") - F.avg("x").over(b)) / F.nullif(F.stddev_pop("x").over(b) * F.sqrt(F.count("*").over(b)), F.lit(0.0))
    z = part.withColumn("_n", F.count("*").over(b)).withColumn("z", z).where("_n = 2 * half + 1")
    mean = z.groupBy("record_id", "o").agg(F.sum("z").alias("z"), F.count("*").alias("beats"), F.count("z").alias("real"))
    score = mean.groupBy("record_id").agg(F.when(F.min(F.col("real") == F.col("beats")), F.sum(F.col("z") * F.col("z") / (F.col("beats") * F.col("beats")))).alias("i_score"))
    out = df.select("record_id").distinct()
    for more in (figures, crossed, beat.drop("half"), tops, score):
        out = out.join(more, "record_id", "left")
    ok = ecg.acceptable(F.coalesce("flat_share", F.lit(0.0)), F.col("crossings"), F.col("heart_rate"), F.col("amplitude"), F.col("i_score"), most_crossings, rates, most_amplitude, least_score)
    return out.withColumn("acceptable", F.coalesce(ok, F.lit(0)))


def nn_intervals(peaks: DataFrame, samples: DataFrame, fs: float, length: int, low: float = 250, high: float = 2500) -> DataFrame:
    """(record_id, segment, i, nn): intervals in ms between neighbouring peaks of one segment of ``length`` samples, strictly inside
    (low, high), neither end at a sample with status 0. Ends are looked up by one equi-join."""
    at = peaks.select("record_id", "i").join(samples.select("record_id", "i", "status"), ["record_id", "i"], "left").withColumn("segment", F.expr(f"i div {length}"))
    w = Window.partitionBy("record_id", "segment").orderBy("i")
    nn = at.select("record_id", "segment", "i", ((F.col("i") - F.lag("i").over(w)) * 1000 / fs).alias("nn"), (F.least(F.coalesce("status", F.lit(1)), F.coalesce(F.lag("status").over(w), F.lit(1))) != 0).alias("_ok"))
    return ecg.normal(nn.where("_ok AND nn IS NOT NULL"), low, high, strict=True).drop("_ok")


def beat_clusters(correlations: DataFrame, group: str, beat: str, low: float = 0.5, high: float = 0.9) -> DataFrame:
    """(group, n_suspects, n_groups, n_noise, a_score) of each window's beat correlations (beat, other, r): a handful of beats.

    Beats that correlate under ``low`` with the one of highest mean are suspects; in turn the first one is taken with all suspects
    it correlates with over ``high + 0.0051``, as a group or, alone, as noise, and scored by how many came before. The score is
    null without suspects, and where the mean correlation is under ``low`` or over ``high``.
    """
    kind = dict(correlations.dtypes)[group]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index=beat, columns="other", values="r").sort_index().sort_index(axis=1).to_numpy(float)
        means = m.mean(1)
        out = {group: pdf[group].iloc[0], "n_suspects": 0, "n_groups": 0, "n_noise": 0, "a_score": None}
        if low <= means.mean() <= high:
            main = m[int(np.nanargmax(means))]
            left, scores = list(np.flatnonzero(main < low)), []
            out["n_suspects"] = len(left)
            while left:
                near = [k for k in left if k == left[0] or m[left[0], k] > high + 0.0051]
                if len(near) == 1:
                    out["n_noise"] += 1
                    scores.append(1.6 * np.exp(-0.4 * out["n_noise"]) - 0.01)
                else:
                    out["n_groups"] += 1
                    scores.append((m[left[0], near].sum() - 1) / (len(near) - 1) * (1.7 * np.exp(-0.5 * out["n_groups"]) - 0.005))
                left = [k for k in left if k not in near]
            good = np.flatnonzero(main >= low)
            if scores:
                out["a_score"] = float((np.mean(scores) + m[np.ix_(good, good)].mean()) / 2)
        return pd.DataFrame([out])

    return correlations.select(group, beat, "other", "r").groupBy(group).applyInPandas(one, f"{group} {kind}, n_suspects long, n_groups long, n_noise long, a_score double")


def long_features(df: DataFrame, keys: Sequence[str], family: str) -> DataFrame:
    """(keys, family, metric, value): every other column as rows; null and NaN are left out."""
    metrics = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot(list(keys), metrics, "metric", "value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, F.lit(family).alias("family"), "metric", "value")


def on_spine(spine: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each of the spine's keys; nulls where a segment has no features."""
    return spine.select(*keys).distinct().join(df, list(keys), "left")

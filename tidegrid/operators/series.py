"""Ordered operators over sampled signals: one row a sample, ``record_id`` and ``ts_ns`` (BIGINT nanoseconds).

All windows are partitioned by record (and segment), so a record is what one
task must hold in order; no frame reaches to the end of a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(*keys: str, order: Sequence[str | Column] = ("ts_ns",)) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def row_index(df: DataFrame, name: str = "i", key: str = "record_id") -> DataFrame:
    """Position of each sample in its record, from 0."""
    return df.withColumn(name, F.row_number().over(by(key)) - 1)


def valid_flag(value: Column, low: float, high: float, when_null: bool = False) -> Column:
    """1 inside the closed range, else 0; a missing value counts as ``when_null``."""
    return F.coalesce(value.between(low, high), F.lit(when_null)).cast("int")


def dedupe_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row by ``order`` of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def differences(df: DataFrame, value: str, name: str = "delta", key: str = "record_id") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(by(key)))


def gap_stats(df: DataFrame, step_ns: int) -> DataFrame:
    """Regular steps (0.5 to 1.5 of the nominal one) and longer gaps of each record."""
    d = differences(df, "ts_ns").where("delta IS NOT NULL")
    gap = F.col("delta") > 1.5 * step_ns
    good = (F.col("delta") > 0.5 * step_ns) & (F.col("delta") < 1.5 * step_ns)
    return d.groupBy("record_id").agg(
        F.count(F.when(good, 1)).alias("n_valid"), F.count(F.when(gap, 1)).alias("n_missing"),
        F.avg(F.when(good, F.col("delta") / 1e9)).alias("mean_valid_s"), F.avg(F.when(gap, F.col("delta") / 1e9)).alias("mean_missing_s"),
    )


def islands(df: DataFrame, bad: str, drop_last: bool = True, inclusive: bool = False) -> DataFrame:
    """Runs of samples where ``bad`` is 1: record_id, first, last, length in samples.

    ``inclusive`` counts both ends; ``drop_last`` leaves out the last run of each record.
    """
    at = row_index(df, "_i").where(F.col(bad) == 1)
    run = at.withColumn("_g", F.col("_i") - F.row_number().over(by("record_id")))
    out = run.groupBy("record_id", "_g").agg(F.min("_i").alias("first"), F.max("_i").alias("last"))
    out = out.withColumn("length", F.col("last") - F.col("first") + int(inclusive))
    if drop_last:
        out = out.withColumn("_next", F.lead("first").over(by("record_id", order=("first",)))).where("_next IS NOT NULL").drop("_next")
    return out.drop("_g")


def dilate(df: DataFrame, bad: str, rows: int, name: str = "dilated") -> DataFrame:
    """1 within so many rows of any row where ``bad`` is 1."""
    return df.withColumn(name, F.max(bad).over(by("record_id").rowsBetween(-rows, rows)))


def gradient(df: DataFrame, value: str, x: Column, name: str = "slope") -> DataFrame:
    """Second-order central differences on an irregular axis, one-sided at the ends."""
    w = by("record_id")
    df = df.withColumn("_x", x)
    f, f0, f1 = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = F.col("_x") - F.lag("_x").over(w), F.lead("_x").over(w) - F.col("_x")
    inner = (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hs + hd))
    return df.withColumn(name, F.when(f0.isNull(), (f1 - f) / hd).when(f1.isNull(), (f - f0) / hs).otherwise(inner)).drop("_x")


def tiles(df: DataFrame, length: int, name: str = "segment") -> DataFrame:
    """Tumbling segments of ``length`` samples; a partial one at the end is dropped."""
    at = row_index(df, "_i")
    n = F.count("*").over(Window.partitionBy("record_id"))
    return at.withColumn("_n", n).withColumn(name, F.expr(f"_i div {length}")).where(f"({name} + 1) * {length} <= _n").drop("_n", "_i")


def tiles_before_end(df: DataFrame, length: int, name: str = "segment") -> DataFrame:
    """As ``tiles``, but a last segment that ends exactly with the record is dropped too."""
    at = row_index(df, "_i").withColumn("_n", F.count("*").over(Window.partitionBy("record_id")))
    return at.withColumn(name, F.expr(f"_i div {length}")).where(f"({name} + 1) * {length} < _n").drop("_n", "_i")


def flat_checks(df: DataFrame, value: str, width: int, hop: int, step: float, key: str = "record_id") -> DataFrame:
    """Share of small steps in the ``width`` samples before every ``hop``-th one from ``width`` on."""
    w = by(key)
    d = df.withColumn("_d", F.lead(value).over(w) - F.col(value)).withColumn("_i", F.row_number().over(w) - 1)
    d = d.withColumn("share", F.sum((F.abs("_d") < step).cast("int")).over(w.rowsBetween(-width, -2)) / F.lit(width))
    return d.where((F.col("_i") >= width) & (F.pmod(F.col("_i") - width, F.lit(hop)) == 0)).select(key, F.col("_i").alias("place"), "share")


def zero_crossings(df: DataFrame, value: str, key: str = "record_id") -> DataFrame:
    before = F.lag(value).over(by(key))
    return df.withColumn("_c", (F.col(value) * before < 0).cast("int")).groupBy(key).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("crossings"))


def min_max(df: DataFrame, value: str, name: str = "scaled", key: str = "record_id") -> DataFrame:
    """Scaled to 0..1 by record; null where a record is constant."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(high > low, (F.col(value) - low) / (high - low)))


def quantile_scaled(df: DataFrame, value: str, q: float, name: str = "scaled") -> DataFrame:
    top = df.groupBy("record_id").agg(F.percentile(value, F.lit(q)).alias("_q"))
    return df.join(top, "record_id").withColumn(name, F.try_divide(F.col(value), F.col("_q"))).drop("_q")


def grid(df: DataFrame, step_ns: int) -> DataFrame:
    """Regular times of each record from its first sample on, the last not after its last one."""
    ends = df.groupBy("record_id").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    return ends.select("record_id", F.explode(F.expr(f"sequence(a, a + ((b - a) div {step_ns}) * {step_ns}, {step_ns}L)")).alias("ts_ns"))


def as_of(left: DataFrame, right: DataFrame, value: str, direction: str, strict: bool = False, name: str | None = None, key: str = "record_id") -> DataFrame:
    """For each row of ``left`` the nearest ``value`` of ``right`` before ("backward") or after ("forward") it.

    Both sides are laid in one order and the last value seen is carried on: one
    shuffle and one sort, never more rows than both inputs have. Equal times count
    unless ``strict``.
    """
    name = name or value
    cols = [c for c in left.columns if c not in (key, "ts_ns")]
    # 0 sorts first; for equal times the side that may see the other one comes later.
    here, there = (0, 1) if strict else (1, 0)
    rows = left.select(key, "ts_ns", F.struct(*[F.col(c) for c in cols] or [F.lit(1).alias("_")]).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(here).alias("_s"))
    more = right.where(F.col(value).isNotNull()).select(key, "ts_ns", F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), F.lit(there).alias("_s"))
    order = (F.col("ts_ns").asc() if direction == "backward" else F.col("ts_ns").desc(), F.col("_s").asc())
    w = by(key, order=order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(more).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    return out.select(key, "ts_ns", *[F.col("_l")[c].alias(c) for c in cols], name)


def resample(df: DataFrame, values: Sequence[str], step_ns: int, flags: Sequence[str] = (), discrete: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation onto ``grid``; a flag is 1 if it is on both sides, a discrete column takes the next value.

    A grid time that is a sample's own takes that sample as the next one and its
    predecessor as the one before; the first grid time takes the first two.
    """
    own = [*values, *flags, *discrete]
    samples = df.select("record_id", "ts_ns", F.struct("ts_ns", *own).alias("_s"))
    g = grid(df, step_ns)
    second = df.withColumn("_rn", F.row_number().over(by("record_id"))).where("_rn = 2").select("record_id", F.struct("ts_ns", *own).alias("_two"))
    both = as_of(as_of(g, samples, "_s", "backward", strict=True, name="_p"), samples, "_s", "forward", name="_n")
    both = both.join(second, "record_id", "left")
    p, n = F.coalesce("_p", "_n"), F.when(F.col("_p").isNull(), F.coalesce("_two", "_n")).otherwise(F.coalesce("_n", "_p"))
    both = both.select("record_id", "ts_ns", p.alias("p"), n.alias("n"))
    share = F.when(F.col("n.ts_ns") > F.col("p.ts_ns"), (F.col("ts_ns") - F.col("p.ts_ns")) / (F.col("n.ts_ns") - F.col("p.ts_ns"))).otherwise(0.0)
    return both.select(
        "record_id", "ts_ns",
        *[(F.col(f"p.{v}") + (F.col(f"n.{v}") - F.col(f"p.{v}")) * share).alias(v) for v in values],
        *[F.col(f"p.{v}").bitwiseAND(F.col(f"n.{v}")).alias(v) for v in flags],
        *[F.col(f"n.{v}").alias(v) for v in discrete],
    )


def coalescing_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join in which the left value wins unless it is null."""
    names = [key, *dict.fromkeys(c for c in (*left.columns, *right.columns) if c != key)]
    a, b = left.select(F.struct("*").alias("a")), right.select(F.struct("*").alias("b"))
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: [F.col(f"{s}.{c}") for s, df in (("a", left), ("b", right)) if c in df.columns]
    return both.select(*[F.coalesce(*pick(c)).alias(c) for c in names])


def interval_mask(df: DataFrame, intervals: DataFrame, name: str = "inside") -> DataFrame:
    """1 for the samples from the last at or before an interval's start through the first after its end.

    Starts and ends are turned into positions by two as-of passes and summed up
    along the record, so overlapping intervals and many of them cost no range join.
    """
    at = row_index(df, "_i")
    place = at.select("record_id", "ts_ns", "_i")
    last = at.groupBy("record_id").agg(F.max("_i").alias("_last"))
    keyed = intervals.select("record_id", "start_ns", "end_ns")
    s = as_of(keyed.withColumnRenamed("start_ns", "ts_ns"), place, "_i", "backward", name="_a").withColumnRenamed("ts_ns", "start_ns")
    e = as_of(s.withColumnRenamed("end_ns", "ts_ns"), place, "_i", "forward", strict=True, name="_b").join(last, "record_id")
    e = e.select("record_id", F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.col("_last")).alias("_b"))
    steps = e.select("record_id", F.explode(F.array(F.struct(F.col("_a").alias("_i"), F.lit(1).alias("_d")), F.struct((F.col("_b") + 1).alias("_i"), F.lit(-1).alias("_d")))).alias("x")).select("record_id", "x.*")
    steps = steps.groupBy("record_id", "_i").agg(F.sum("_d").alias("_d"))
    w = by("record_id", order=("_i",)).rowsBetween(Window.unboundedPreceding, 0)
    return at.join(steps, ["record_id", "_i"], "left").withColumn(name, (F.sum(F.coalesce("_d", F.lit(0))).over(w) > 0).cast("int")).drop("_d", "_i")


def containment(events: DataFrame, length: int, first: str, last: str) -> DataFrame:
    """Intervals that lie in one tile of ``length``, rebased to its start."""
    tile = F.expr(f"{first} div {length}")
    return events.where(tile == F.expr(f"{last} div {length}")).withColumn("segment", tile).withColumns({first: F.col(first) - tile * length, last: F.col(last) - tile * length})


def frame_means(df: DataFrame, frame: str, values: Sequence[str], frames: int) -> DataFrame:
    """Mean of each column for every frame number below ``frames``, null where a frame has no row."""
    means = df.groupBy(frame).agg(*[F.avg(v).alias(v) for v in values])
    return df.sparkSession.range(frames).withColumnRenamed("id", frame).join(means, frame, "left")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same in every run: those whose key has the least MD5 with the seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def quantiles(df: DataFrame, keys: Sequence[str], x: str, shares: Sequence[float], bins: int = 4096) -> DataFrame:
    """(keys, share, value): exact quantiles with linear interpolation.

    A histogram of each group tells which bins hold the wanted ranks; only the
    values of these are counted and ordered, so no task sees a whole group.
    """
    own = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    ends = own.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.count("*").alias("_n"))
    place = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = own.join(ends, list(keys)).withColumn("_bin", place)
    counted = binned.groupBy(*keys, "_bin", "_n").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    rank = [F.floor((F.col("_n") - 1) * q).cast("long") for q in shares]
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("share"), (r + d).alias("rank"), F.lit(d).alias("upper")) for q, r in zip(shares, rank, strict=True) for d in (0, 1)])
    hit = counted.select(*keys, "_bin", "_n", "_before", "_c", F.explode(wanted).alias("_w")).where("_w.rank >= _before AND _w.rank < _before + _c")
    values = binned.join(hit.select(*keys, "_bin").distinct(), [*keys, "_bin"]).groupBy(*keys, "_bin", "_x").agg(F.count("*").alias("_m"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_less", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    found = hit.drop("_n", "_c").join(values, [*keys, "_bin"]).where("_w.rank - _before >= _less AND _w.rank - _before < _less + _m")
    both = found.groupBy(*keys, F.col("_w.share").alias("share")).agg(F.max(F.when(F.col("_w.upper") == 0, F.col("_x"))).alias("_lo"), F.max(F.when(F.col("_w.upper") == 1, F.col("_x"))).alias("_hi"))
    both = both.join(ends.select(*keys, "_n"), list(keys))
    part = (F.col("_n") - 1) * F.col("share") - F.floor((F.col("_n") - 1) * F.col("share"))
    return both.select(*keys, "share", (F.col("_lo") + (F.coalesce("_hi", "_lo") - F.col("_lo")) * part).alias("value"))


def middle(df: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """The rows of each record from place ``int(low n)`` up to ``int(high n)``."""
    at = row_index(df, "_i").withColumn("_n", F.count("*").over(Window.partitionBy("record_id")))
    return at.where((F.col("_i") >= F.floor(F.col("_n") * low)) & (F.col("_i") < F.floor(F.col("_n") * high))).drop("_i", "_n")

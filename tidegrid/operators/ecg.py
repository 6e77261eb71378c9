"""Heart signals: the Pan-Tompkins filters, beats, intervals and their variability (``record_id``, ``i``, value).

Every filter is written with running sums over bounded frames or lags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w() -> Window:
    return Window.partitionBy("record_id").orderBy("i")


def low_pass(df: DataFrame, x: str, name: str = "low") -> DataFrame:
    """y = 2 y1 - y2 + x - 2 x6 + x12 from rest: two moving sums of six, one after the other."""
    six = _w().rowsBetween(-5, 0)
    return df.withColumn("_s", F.sum(x).over(six)).withColumn(name, F.sum("_s").over(six)).drop("_s")


def high_pass(df: DataFrame, x: str, name: str = "high") -> DataFrame:
    """y = -y1 - x + 32 x16 + x32 from rest."""
    w = _w()
    lag = lambda k: F.coalesce(F.lag(x, k).over(w), F.lit(0.0))
    sign = F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_u", sign * (32 * lag(16) + lag(32) - F.col(x))).withColumn(name, sign * F.sum("_u").over(run)).drop("_u")


def peak_scaled(df: DataFrame, x: str, name: str) -> DataFrame:
    top = Window.partitionBy("record_id")
    return df.withColumn(name, F.try_divide(F.col(x), F.greatest(F.max(x).over(top), -F.min(x).over(top))))


def five_point(df: DataFrame, x: str, fs: float, name: str = "derivative") -> DataFrame:
    """(-x2 - 2 x1 + 2 x-1 + x-2) fs / 8; terms that reach outside are left out."""
    w = _w()
    z = lambda k: F.coalesce((F.lag(x, k) if k > 0 else F.lead(x, -k)).over(w), F.lit(0.0))
    behind = F.when(F.col("i") >= 2, -2 * z(1) - z(2)).when(F.col("i") == 1, -2 * z(1)).otherwise(0.0)
    return df.withColumn(name, (behind + 2 * z(-1) + z(-2)) * fs / 8)


def moving(df: DataFrame, x: str, n: int, name: str, centred: bool = False) -> DataFrame:
    """Sum over ``n`` samples (trailing or centred) divided by ``n``, zeros outside."""
    frame = _w().rowsBetween(-(n // 2), n // 2) if centred else _w().rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.sum(x).over(frame) / n)


def local_maxima(df: DataFrame, x: str, start: int) -> DataFrame:
    """Samples greater than both neighbours, from place ``start`` on."""
    w = _w()
    return df.withColumns({"_a": F.lag(x).over(w), "_b": F.lead(x).over(w)}).where((F.col("i") >= start) & (F.col(x) > F.col("_a")) & (F.col(x) > F.col("_b"))).drop("_a", "_b")


def raised(df: DataFrame, peak: str, x: str, reach: int) -> DataFrame:
    """For each sample marked by ``peak``, the place of the greatest value from ``reach`` before to just under ``reach`` after it, the first of equal ones."""
    best = F.max(F.struct(F.col(x), -F.col("i"))).over(_w().rowsBetween(-reach, reach - 1))
    return df.withColumn("_m", best).where(F.col(peak) == 1).select("record_id", "i", (-F.col("_m").getField("col2")).alias("raised"))


def snapped(df: DataFrame, peak: str, x: str, reach: int) -> DataFrame:
    """For each sample marked by ``peak``, the place of the greatest value within ``reach``, the first of equal ones."""
    best = F.max(F.struct(F.col(x), -F.col("i"))).over(_w().rowsBetween(-reach, reach))
    return df.withColumn("_m", best).where(F.col(peak) == 1).select("record_id", "i", (-F.col("_m").getField("col2")).alias("snapped"))


def front_end(df: DataFrame, x: str, fs: float) -> DataFrame:
    """Band-pass, derivative, square and integration, each as a column."""
    out = high_pass(low_pass(df, x), "low")
    out = peak_scaled(out, "high", "band")
    out = five_point(out, "band", fs).withColumn("squared", F.col("derivative") * F.col("derivative"))
    return moving(out, "squared", max(1, round(0.15 * fs)), "integrated")


def candidates(df: DataFrame, fs: float) -> DataFrame:
    """(record_id, p, ...): candidate beats of ``front_end``'s output, with all that the decision on them looks at.

    p is a local maximum of the integrated signal smoothed over 25 samples, later than half a second; m the integrated
    signal there, (b, r) the highest band-passed value within 150 ms and its place, slope the steepest rise of the integrated
    signal in the 75 ms before p. For the search back: (bx, x) its highest value since the candidate before, and
    (bb, bp) the highest band-passed value in the 150 ms before x. Of equal values the first one counts.
    """
    w, half = round(0.15 * fs), max(1, round(round(0.15 * fs) / 2))
    o = _w()
    out = moving(df.select("record_id", "i", "integrated", "band"), "integrated", 25, "_s", centred=True)
    peak = (F.col("i") >= round(0.5 * fs) + 1) & (F.col("_s") > F.lag("_s").over(o)) & (F.col("_s") > F.lead("_s").over(o))
    inner = F.when(F.lead("i").over(o).isNotNull(), F.struct(F.col("band").alias("v"), (-F.col("i")).alias("at")))
    out = out.select("record_id", "i", "integrated", F.coalesce(peak, F.lit(False)).cast("int").alias("_peak"), inner.alias("_in"), F.struct(F.col("band").alias("v"), (-F.col("i")).alias("at")).alias("_b"), (F.col("integrated") - F.lag("integrated").over(o)).alias("_d"))
    out = out.select(
        "record_id", "i", "integrated", "_peak", F.max("_in").over(o.rowsBetween(-w, w - 1)).alias("_top"), F.max("_d").over(o.rowsBetween(1 - half, 0)).alias("slope"),
        F.max("_b").over(o.rowsBetween(-w, -1)).alias("_behind"), F.coalesce(F.sum("_peak").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_gap"),
    )
    highest = F.max(F.struct("integrated", (-F.col("i")).alias("at"), "_behind")).over(Window.partitionBy("record_id", "_gap"))
    out = out.withColumn("_h", highest).where("_peak = 1")
    return out.select(
        "record_id", F.col("i").alias("p"), F.col("integrated").alias("m"), F.col("_top.v").alias("b"), (-F.col("_top.at")).alias("r"), "slope",
        F.col("_h.integrated").alias("bx"), F.col("_h._behind.v").alias("bb"), (-F.col("_h._behind.at")).alias("bp"),
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _with(state: Column, **new: Column) -> Column:
    """A struct with some fields set or added."""
    for name, value in new.items():
        state = state.withField(name, value)
    return state


def decided(found: DataFrame, fs: float) -> DataFrame:
    """(record_id, r): places of beats among ``candidates``, by one fold over each record's (a segment of some minutes).

    Signal and noise levels of both signals move by an eighth with each candidate; thresholds lie a quarter from noise
    to signal. A candidate over the integrated threshold is a beat if the band-passed one is passed too, unless it
    comes 200 to 360 ms after the candidate before and rises less than half as steeply (a T wave). Limits on intervals
    follow the mean of the last eight, or of the last eight that lay within 0.92 to 1.16 of it; where that mean leaves
    the limits, thresholds are halved; after 1.66 of it without a candidate the highest value since is searched back, and
    moves the levels by a quarter. Places are counted in the record, and levels are those of a candidate's own peak.
    """
    last8 = lambda a: F.slice(a, F.greatest(F.size(a) - 7, F.lit(1)), F.lit(8))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    toward = lambda level, value, share: share * value + (1 - share) * level
    bound = lambda noise, signal: noise + 0.25 * (signal - noise)
    no = F.lit(False)

    def intervals_of(s: Column, c: Column) -> Column:
        rr = last8(F.concat(s["rr"], F.when(s["k"] > 0, F.array((c["p"] - s["prev"]) / fs)).otherwise(F.array().cast("array<double>"))))
        return _with(s, rr=rr, rrn=F.when(s["k"] > 0, (c["p"] - s["prev"]) / fs))

    def averages(s: Column) -> Column:
        fits = F.when(s["k"] >= 8, F.filter(s["rr"], lambda x: (x > s["low"]) & (x < s["high"]))).otherwise(F.array().cast("array<double>"))
        both = F.concat(s["rr2"], fits)
        fresh = (F.size(fits) > 0) & (F.size(both) > 8)
        return _with(s, mean1=F.when(s["k"] > 0, mean(s["rr"])), mean2=F.when(fresh, mean(last8(both))).when(s["k"] > 0, mean(s["rr"])), rr2=last8(both))

    def limits(s: Column) -> Column:
        moves = (s["k"] > 0) & ((F.size(s["rr2"]) > 7) | (s["k"] < 8))
        each = {n: F.when(moves, x * s["mean2"]).otherwise(s[n]) for n, x in (("low", 0.92), ("high", 1.16), ("missed", 1.66))}
        return _with(s, **each)

    def halved(s: Column) -> Column:
        by = F.when(F.coalesce((s["mean1"] < s["low"]) | (s["mean1"] > s["missed"]), no), 2.0).otherwise(1.0)
        return _with(s, i1=s["i1"] / by, f1=s["f1"] / by)

    def searched(s: Column, c: Column) -> Column:
        back = F.coalesce((s["rrn"] > s["missed"]) & (c["bx"] > s["i1"]), no)
        deep = back & F.coalesce((c["bb"] > s["f1"]) & (c["bb"] > s["f2"]), no)
        spki, spkf = F.when(back, toward(s["spki"], c["bx"], 0.25)).otherwise(s["spki"]), F.when(deep, toward(s["spkf"], c["bb"], 0.25)).otherwise(s["spkf"])
        i1, f1 = F.when(back, bound(s["npki"], spki)).otherwise(s["i1"]), F.when(deep, bound(s["npkf"], spkf)).otherwise(s["f1"])
        return _with(s, spki=spki, spkf=spkf, i1=i1, f1=f1, found=F.when(deep, F.concat(s["found"], F.array(c["bp"]))).otherwise(s["found"]))

    def judged(s: Column, c: Column) -> Column:
        strong = c["m"] >= s["i1"]
        wave = strong & F.coalesce((s["rrn"] > 0.2) & (s["rrn"] < 0.36) & (c["slope"] < 0.5 * s["slope"]), no)
        return _with(s, strong=strong & ~wave, wave=wave, high_f=c["b"] > s["f1"])

    def moved(s: Column, c: Column) -> Column:
        own = lambda n, cond, v: F.when(cond, toward(s[n], v, 0.125)).otherwise(s[n])
        quiet = ~s["strong"] & ~s["wave"]
        return _with(
            s, spki=own("spki", s["strong"], c["m"]), npki=own("npki", ~s["strong"], c["m"]), spkf=own("spkf", s["strong"] & s["high_f"], c["b"]),
            npkf=own("npkf", quiet | (s["strong"] & ~s["high_f"]), c["b"]), found=F.when(s["strong"] & s["high_f"], F.concat(s["found"], F.array(c["r"]))).otherwise(s["found"]),
        )

    def closed(s: Column, c: Column) -> Column:
        i1, f1 = bound(s["npki"], s["spki"]), bound(s["npkf"], s["spkf"])
        now = {"k": s["k"] + 1, "prev": c["p"], "slope": c["slope"], "i1": i1, "f1": f1, "f2": 0.5 * f1}
        return F.struct(*[now.get(n, s[n]).alias(n) for n in fields])

    def step(s: Column, c: Column) -> Column:
        for then in (lambda t: intervals_of(t, c), averages, limits, halved, lambda t: searched(t, c), lambda t: judged(t, c), lambda t: moved(t, c), lambda t: closed(t, c)):
            s = _let(s, then)
        return s

    numbers = ("slope", "low", "high", "missed", "spki", "npki", "spkf", "npkf", "i1", "f1", "f2")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = {"k": F.lit(0), "prev": F.lit(0).cast("long"), **{n: F.lit(0.0) for n in numbers}, "rr": none("double"), "rr2": none("double"), "found": none("bigint")}
    fields = list(start)
    each = found.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("p", "m", "b", "r", "slope", "bx", "bb", "bp"))).alias("c"))
    out = each.select("record_id", F.aggregate("c", F.struct(*[v.alias(n) for n, v in start.items()]), step, lambda s: s["found"]).alias("f"))
    return out.select("record_id", F.explode(F.array_distinct("f")).alias("r"))


def r_peaks(df: DataFrame, x: str, fs: float) -> DataFrame:
    """(record_id, i): R peaks of each record: filters, candidates, the decision, and the highest sample within 200 ms of each beat.

    A record is a window or segment of some minutes; what its first samples show is clamped at the first one.
    """
    front = front_end(df, x, fs)
    beats = decided(candidates(front, fs), fs).select("record_id", F.col("r").alias("i"), F.lit(1).alias("_beat"))
    marked = df.select("record_id", "i", x).join(beats, ["record_id", "i"], "left")
    return snapped(marked, "_beat", x, round(0.2 * fs)).select("record_id", F.col("snapped").alias("i")).distinct()


def intervals(peaks: DataFrame, time: str = "t_ms") -> DataFrame:
    """Time from each peak to the next one of its record."""
    w = Window.partitionBy("record_id").orderBy(time)
    return peaks.withColumn("nn", F.lead(time).over(w) - F.col(time)).where("nn IS NOT NULL")


def normal(df: DataFrame, low: float = 250, high: float = 2500, strict: bool = False) -> DataFrame:
    nn = F.col("nn")
    return df.where((nn > low) & (nn < high) if strict else nn.between(low, high))


def variability(df: DataFrame, keys: list[str], order: str, width: float = 7.8125) -> DataFrame:
    """Mean, SDNN (sample), RMSSD and triangular index of the intervals ``nn``."""
    d = df.withColumn("_d", F.col("nn") - F.lag("nn").over(Window.partitionBy(*keys).orderBy(order)))
    bins = df.groupBy(*keys, F.floor(F.col("nn") / width).alias("_b")).agg(F.count("*").alias("_c")).groupBy(*keys).agg((F.sum("_c") / F.max("_c")).alias("tri_index"))
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("nn").alias("mean_nn"), F.stddev_samp("nn").alias("sdnn"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"))
    return out.join(bins, keys)


def heart_rate(df: DataFrame, fs: float, place: str = "i") -> DataFrame:
    """Beats a minute of each record from the mean step between peaks."""
    d = F.col(place) - F.lag(place).over(Window.partitionBy("record_id").orderBy(place))
    return df.withColumn("_d", d).groupBy("record_id").agg((60 * fs / F.avg("_d")).alias("heart_rate"))


def beat_correlations(beats: DataFrame, group: str, beat: str, values: str) -> DataFrame:
    """Pearson correlations of all pairs of beats of one short window (a handful of equal-length arrays)."""
    long = beats.select(group, beat, F.posexplode(values).alias("i", "v"))
    other = long.select(group, F.col(beat).alias("other"), "i", F.col("v").alias("u"))
    return long.join(other, [group, "i"]).groupBy(group, beat, "other").agg(F.corr("v", "u").alias("r"))


def i_score(correlations: DataFrame, group: str, beat: str) -> DataFrame:
    """Mean of all correlations of a window, and the beat of highest mean, the first of equal ones."""
    row = correlations.groupBy(group, beat).agg(F.avg("r").alias("g"))
    return row.groupBy(group).agg(F.avg("g").alias("i_score"), F.max(F.struct(F.round("g", 9), -F.col(beat))).alias("_m")).select(group, "i_score", (-F.col("_m").getField("col2")).alias("best"))


def acceptable(flat_share: Column, crossings: Column, rate: Column, amplitude: Column, score: Column, most_crossings: int = 200, rates: tuple[float, float] = (24, 240), most_amplitude: float = 1500, least_score: float = 0.5) -> Column:
    """The quality rules of an ECG window as one flag."""
    return ((flat_share <= 0.8) & (crossings <= most_crossings) & rate.between(*rates) & (amplitude <= most_amplitude) & (score >= least_score)).cast("int")

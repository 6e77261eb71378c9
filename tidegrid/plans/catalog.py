"""All queries of the time-series operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ecg, features, gaze, hrv, kernels, scanpath, series, skin

H6, HOUR = 6 * 3600 * 10**9, 3600 * 10**9
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = SERIES + sql if ("series" in sql or "beats" in sql) and not sql.startswith("WITH") else sql
        return f

    return add


#: The driver's tables as signals: events by user, and embeddings as waves of 64 samples.
SERIES = """
WITH series AS (
  SELECT user_id AS record_id, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, event_type, value AS v,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n,
         CASE WHEN value BETWEEN 5 AND 100 THEN 1 ELSE 0 END AS ok
  FROM events),
wave AS (
  SELECT vec_id AS record_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i, label FROM embeddings),
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) * 1000")
    out = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), ts.alias("ts_ns"), F.col("event_id").alias("seq"), "event_type", F.col("value").alias("v"))
    return out.withColumn("ok", series.valid_flag(F.col("v"), 5, 100)).withColumn("bad", 1 - F.col("ok"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "label", F.posexplode("embedding").alias("i", "x"))
    return out.withColumns({"x": F.col("x").cast("double"), "i": F.col("i").cast("long"), "ts_ns": F.col("i").cast("long")})


#: Ten embeddings one after the other as a strip of 640 samples, long enough for beats.
STRIPS = "strip AS (SELECT vec_id // 10 AS record_id, (vec_id % 10) * 64 + unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings ten by ten as one signal each."""
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return out.select(F.expr("vec_id div 10").alias("record_id"), (F.col("vec_id") % 10 * 64 + F.col("k")).alias("i"), F.col("x").cast("double").alias("x"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""q AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY record_id ORDER BY ts_ns) AS d FROM series)
SELECT record_id, count(*) AS n, round(avg(ok), 6) AS valid, count(d) FILTER (d > 1.5 * 21600e9) AS n_missing FROM q GROUP BY record_id""")
def record_quality(spark, sf_dir):
    """Valid share and long gaps of each record."""
    own = events(spark, sf_dir)
    share = own.groupBy("record_id").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("valid"))
    return share.join(series.gap_stats(own, H6).select("record_id", "n_missing"), "record_id", "left").fillna(0, ["n_missing"])


@query("""q AS (SELECT record_id, (ts_ns - lag(ts_ns) OVER (PARTITION BY record_id ORDER BY ts_ns)) AS d FROM series),
g AS (SELECT record_id, d / 1e9 AS s, d > 0.5 * 21600e9 AND d < 1.5 * 21600e9 AS good, d > 1.5 * 21600e9 AS gap FROM q WHERE d IS NOT NULL)
SELECT record_id, count(*) FILTER (good) AS n_valid, count(*) FILTER (gap) AS n_missing, round(avg(s) FILTER (good), 3) AS mean_valid_s, round(avg(s) FILTER (gap), 3) AS mean_missing_s FROM g GROUP BY record_id""")
def gap_stats(spark, sf_dir):
    return rounded(series.gap_stats(events(spark, sf_dir), H6), "mean_valid_s", "mean_missing_s", digits=3)


@query("""b AS (SELECT record_id, i, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS g FROM series WHERE ok = 0),
r AS (SELECT record_id, min(i) AS first, max(i) AS last FROM b GROUP BY record_id, g)
SELECT record_id, first, last, last - first AS length FROM r QUALIFY lead(first) OVER (PARTITION BY record_id ORDER BY first) IS NOT NULL""")
def islands_invalid(spark, sf_dir):
    return series.islands(events(spark, sf_dir), "bad")


@query("""b AS (SELECT record_id, i, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS g FROM series WHERE ok = 0),
r AS (SELECT record_id, max(i) - min(i) + 1 AS length FROM b GROUP BY record_id, g)
SELECT length, count(*) AS n FROM r GROUP BY length""")
def island_lengths(spark, sf_dir):
    return series.islands(events(spark, sf_dir), "bad", drop_last=False, inclusive=True).groupBy("length").agg(F.count("*").alias("n"))


@query("""SELECT record_id, ts_ns, max(1 - ok) OVER (PARTITION BY record_id ORDER BY ts_ns ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM series""".replace("SELECT record_id, ts_ns, max", "x AS (SELECT 1) SELECT record_id, ts_ns, max"))
def dilated_mask(spark, sf_dir):
    return series.dilate(events(spark, sf_dir), "bad", 2).select("record_id", "ts_ns", "dilated")


@query("""q AS (SELECT record_id, ts_ns, v AS f, ts_ns / 3.6e12 AS x, lag(v) OVER w AS f0, lead(v) OVER w AS f1, ts_ns / 3.6e12 - lag(ts_ns / 3.6e12) OVER w AS hs, lead(ts_ns / 3.6e12) OVER w - ts_ns / 3.6e12 AS hd FROM series WINDOW w AS (PARTITION BY record_id ORDER BY ts_ns))
SELECT record_id, ts_ns, round(CASE WHEN f0 IS NULL THEN (f1 - f) / hd WHEN f1 IS NULL THEN (f - f0) / hs ELSE (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hs + hd)) END, 3) AS slope FROM q""")
def gradient_slope(spark, sf_dir):
    out = series.gradient(events(spark, sf_dir), "v", F.col("ts_ns") / 3.6e12)
    return rounded(out.select("record_id", "ts_ns", "slope"), "slope", digits=3)


@query("""q AS (SELECT record_id, i // 10 AS segment, v FROM series WHERE (i // 10 + 1) * 10 <= n)
SELECT record_id, segment, count(*) AS n, round(avg(v), 6) AS mean FROM q GROUP BY record_id, segment""")
def segment_tile(spark, sf_dir):
    return rounded(series.tiles(events(spark, sf_dir), 10).groupBy("record_id", "segment").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


@query("""q AS (SELECT record_id, i // 10 AS segment FROM series WHERE (i // 10 + 1) * 10 < n)
SELECT record_id, max(segment) + 1 AS n_segments FROM q GROUP BY record_id""")
def strict_window_tail(spark, sf_dir):
    return series.tiles_before_end(events(spark, sf_dir), 10).groupBy("record_id").agg((F.max("segment") + 1).alias("n_segments"))


@query("""d AS (SELECT record_id, i, abs(lead(x) OVER (PARTITION BY record_id ORDER BY i) - x) < 0.1 AS small FROM wave),
s AS (SELECT record_id, i AS place, sum(small::INT) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 2 PRECEDING) / 20.0 AS share FROM d)
SELECT record_id, place, round(share, 6) AS share FROM s, (SELECT 1 FROM series LIMIT 1) WHERE place >= 20 AND (place - 20) % 5 = 0""")
def sliding_flat_check(spark, sf_dir):
    return rounded(series.flat_checks(waves(spark, sf_dir), "x", 20, 5, 0.1), "share")


@query("""c AS (SELECT record_id, (x * lag(x) OVER (PARTITION BY record_id ORDER BY i) < 0)::INT AS c FROM wave)
SELECT record_id, coalesce(sum(c), 0)::BIGINT AS crossings FROM c, (SELECT 1 FROM series LIMIT 1) GROUP BY record_id""")
def zero_crossings(spark, sf_dir):
    return series.zero_crossings(waves(spark, sf_dir), "x")


@query("""q AS (SELECT record_id, ts_ns, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM series WINDOW w AS (PARTITION BY record_id))
SELECT record_id, ts_ns, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) END, 6) AS scaled FROM q""")
def minmax_normalised(spark, sf_dir):
    return rounded(series.min_max(events(spark, sf_dir), "v").select("record_id", "ts_ns", "scaled"), "scaled")


@query("""q AS (SELECT record_id, quantile_cont(v, 0.995) AS q FROM series GROUP BY record_id)
SELECT record_id, ts_ns, round(v / q, 6) AS scaled FROM series JOIN q USING (record_id)""")
def quantile_norm(spark, sf_dir):
    return rounded(series.quantile_scaled(events(spark, sf_dir), "v", 0.995).select("record_id", "ts_ns", "scaled"), "scaled")


_GRID = """e AS (SELECT record_id, min(ts_ns) AS a, max(ts_ns) AS b FROM series GROUP BY record_id),
g AS (SELECT record_id, unnest(range(a, a + ((b - a) // 21600000000000) * 21600000000000 + 1, 21600000000000)) AS ts_ns FROM e),
two AS (SELECT record_id, ts_ns AS t2, v AS v2, ok AS ok2 FROM series WHERE i = 1),
p AS (SELECT g.record_id, g.ts_ns, s.ts_ns AS pt, s.v AS pv, s.ok AS pok FROM g ASOF LEFT JOIN series s ON g.record_id = s.record_id AND g.ts_ns > s.ts_ns),
n AS (SELECT p.*, s.ts_ns AS nt, s.v AS nv, s.ok AS nok FROM p ASOF LEFT JOIN series s ON p.record_id = s.record_id AND p.ts_ns <= s.ts_ns),
f AS (SELECT n.record_id, n.ts_ns, coalesce(pt, nt) AS pt, coalesce(pv, nv) AS pv, coalesce(pok, nok) AS pok,
        CASE WHEN pt IS NULL THEN coalesce(t2, nt) ELSE nt END AS nt, CASE WHEN pt IS NULL THEN coalesce(v2, nv) ELSE nv END AS nv, CASE WHEN pt IS NULL THEN coalesce(ok2, nok) ELSE nok END AS nok
      FROM n LEFT JOIN two USING (record_id))"""


@query(_GRID + """ SELECT record_id, ts_ns, round(pv + (nv - pv) * CASE WHEN nt > pt THEN (ts_ns - pt) / (nt - pt)::DOUBLE ELSE 0 END, 6) AS v FROM f""")
def resample_linear(spark, sf_dir):
    return rounded(series.resample(events(spark, sf_dir), ["v"], H6), "v")


@query(_GRID + """ SELECT record_id, ts_ns, (pok & nok) AS ok FROM f""")
def resample_status_and(spark, sf_dir):
    return series.resample(events(spark, sf_dir), [], H6, flags=["ok"])


_SIDES = "l AS (SELECT record_id, ts_ns, seq FROM series WHERE event_type = 'click'), r AS (SELECT record_id, ts_ns, v FROM series WHERE event_type = 'error')"


def _click_error(spark, sf_dir):
    own = events(spark, sf_dir)
    return own.where("event_type = 'click'").select("record_id", "ts_ns", "seq"), own.where("event_type = 'error'").select("record_id", "ts_ns", "v")


@query(_SIDES + " SELECT l.record_id, l.ts_ns, l.seq, r.v FROM l ASOF LEFT JOIN r ON l.record_id = r.record_id AND l.ts_ns < r.ts_ns")
def asof_strict_forward(spark, sf_dir):
    return series.as_of(*_click_error(spark, sf_dir), "v", "forward", strict=True)


@query(_SIDES + " SELECT l.record_id, l.ts_ns, l.seq, r.v FROM l ASOF LEFT JOIN r ON l.record_id = r.record_id AND l.ts_ns >= r.ts_ns")
def asof_backward(spark, sf_dir):
    return series.as_of(*_click_error(spark, sf_dir), "v", "backward")


@query("""k AS (SELECT record_id, ts_ns + 60000000000 AS a, ts_ns + 7200000000000 AS b FROM series WHERE event_type = 'error'),
x AS (SELECT record_id, a, b, coalesce((SELECT max(i) FROM series s WHERE s.record_id = k.record_id AND s.ts_ns <= k.a), 0) AS fi,
        coalesce((SELECT min(i) FROM series s WHERE s.record_id = k.record_id AND s.ts_ns > k.b), (SELECT max(i) FROM series s WHERE s.record_id = k.record_id)) AS li FROM k)
SELECT s.record_id, s.ts_ns, (EXISTS (SELECT 1 FROM x WHERE x.record_id = s.record_id AND s.i BETWEEN x.fi AND x.li))::INT AS inside FROM series s""")
def interval_mask(spark, sf_dir):
    own = events(spark, sf_dir)
    spans = own.where("event_type = 'error'").select("record_id", (F.col("ts_ns") + 60 * 10**9).alias("start_ns"), (F.col("ts_ns") + 2 * HOUR).alias("end_ns"))
    return series.interval_mask(own.select("record_id", "ts_ns"), spans)


@query("""WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders),
r AS (SELECT l_orderkey AS k, max(l_extendedprice) AS price, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(l.k, r.k) AS k, coalesce(l.price, r.price) AS price, r.lines FROM l FULL JOIN r ON l.k = r.k""")
def coalescing_join(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("price"), F.count("*").alias("lines"))
    return series.coalescing_join(left, right, "k")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_quantity > 10"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""q AS (SELECT record_id, ts_ns // 86400000000000 AS day, seq, v, row_number() OVER (PARTITION BY record_id, ts_ns // 86400000000000 ORDER BY seq DESC) AS rn FROM series)
SELECT record_id, day, seq, v FROM q WHERE rn = 1""")
def dedupe_last(spark, sf_dir):
    own = events(spark, sf_dir).select("record_id", F.expr("ts_ns div 86400000000000").alias("day"), "seq", "v")
    return series.dedupe_last(own, ["record_id", "day"], "seq")


_LOW = """s1 AS (SELECT record_id, i, sum(x) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s, x FROM wave),
lo AS (SELECT record_id, i, x, sum(s) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS low FROM s1),
u AS (SELECT *, (CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS sg, 32 * coalesce(lag(low, 16) OVER w, 0) + coalesce(lag(low, 32) OVER w, 0) - low AS uu FROM lo WINDOW w AS (PARTITION BY record_id ORDER BY i)),
hi AS (SELECT *, sg * sum(sg * uu) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM u),
ba AS (SELECT *, high / greatest(max(high) OVER w, -min(high) OVER w) AS band FROM hi WINDOW w AS (PARTITION BY record_id)),
de AS (SELECT *, (CASE WHEN i >= 2 THEN -2 * lag(band) OVER w - lag(band, 2) OVER w WHEN i = 1 THEN -2 * lag(band) OVER w ELSE 0 END + 2 * coalesce(lead(band) OVER w, 0) + coalesce(lead(band, 2) OVER w, 0)) * 64 / 8 AS derivative FROM ba WINDOW w AS (PARTITION BY record_id ORDER BY i)),
it AS (SELECT *, sum(derivative * derivative) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10 AS integrated FROM de),
one AS (SELECT 1 FROM series LIMIT 1)"""


@query(_LOW + " SELECT record_id, i, round(low, 6) AS low, round(high, 6) AS high, round(band, 6) AS band, round(derivative, 6) AS derivative, round(integrated, 6) AS integrated FROM it, one")
def qrs_front_end(spark, sf_dir):
    """Low pass, high pass, derivative, square and moving integration."""
    out = ecg.front_end(waves(spark, sf_dir), "x", 64)
    cols = ["low", "high", "band", "derivative", "integrated"]
    return rounded(out.select("record_id", "i", *cols), *cols)


@query("""s AS (SELECT record_id, i, sum(x) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25 AS y FROM wave)
SELECT record_id, i, round(y, 6) AS y FROM s, (SELECT 1 FROM series LIMIT 1)""")
def smooth25(spark, sf_dir):
    return rounded(ecg.moving(waves(spark, sf_dir), "x", 25, "y", centred=True).select("record_id", "i", "y"), "y")


@query("""q AS (SELECT record_id, i, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM wave WINDOW w AS (PARTITION BY record_id ORDER BY i))
SELECT record_id, i FROM q, (SELECT 1 FROM series LIMIT 1) WHERE i >= 4 AND x > a AND x > b""")
def local_maxima(spark, sf_dir):
    return ecg.local_maxima(waves(spark, sf_dir), "x", 4).select("record_id", "i")


_TOPS = """, k AS (SELECT record_id, i FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM wave WINDOW w AS (PARTITION BY record_id ORDER BY i)) WHERE i >= 1 AND x > a AND x > b),
m AS (SELECT k.record_id, k.i, b.i AS j, b.x, max(b.x) OVER (PARTITION BY k.record_id, k.i) AS top FROM k JOIN wave b ON k.record_id = b.record_id AND b.i BETWEEN k.i - 5 AND k.i + {up})
SELECT record_id, i, min(j) FILTER (x = top) AS {name} FROM m, (SELECT 1 FROM series LIMIT 1) GROUP BY record_id, i"""


def _tops(spark, sf_dir):
    own = waves(spark, sf_dir)
    tops = ecg.local_maxima(own, "x", 1).select("record_id", "i", F.lit(1).alias("peak"))
    return own.join(tops, ["record_id", "i"], "left")


@query("one AS (SELECT 1)" + _TOPS.format(up=5, name="snapped"))
def peak_snap(spark, sf_dir):
    """Each local maximum moved to the highest sample around it."""
    return ecg.snapped(_tops(spark, sf_dir), "peak", "x", 5)


@query("one AS (SELECT 1)" + _TOPS.format(up=4, name="raised"))
def local_argmax(spark, sf_dir):
    """The same with a half-open window."""
    return ecg.raised(_tops(spark, sf_dir), "peak", "x", 5)


@query("""q AS (SELECT record_id, ts_ns // 3600000000000 AS t, lead(ts_ns // 3600000000000) OVER (PARTITION BY record_id ORDER BY ts_ns) - ts_ns // 3600000000000 AS nn FROM series),
k AS (SELECT *, nn - lag(nn) OVER (PARTITION BY record_id ORDER BY t) AS d FROM (SELECT * FROM q WHERE nn BETWEEN 1 AND 48)),
b AS (SELECT record_id, sum(c) / max(c) AS tri FROM (SELECT record_id, floor(nn / 7.8125) AS b, count(*) AS c FROM k GROUP BY ALL) GROUP BY record_id)
SELECT k.record_id, count(*) AS n, round(avg(nn), 6) AS mean_nn, round(stddev_samp(nn), 6) AS sdnn, round(sqrt(avg(d * d)), 6) AS rmssd, round(any_value(tri), 6) AS tri_index FROM k JOIN b USING (record_id) GROUP BY k.record_id""")
def hrv_time(spark, sf_dir):
    # Times in hours: distinct ones, as intervals of 0 are not kept.
    own = events(spark, sf_dir).select("record_id", F.expr("ts_ns div 3600000000000").alias("t_ms"))
    nn = ecg.normal(ecg.intervals(own), 1, 48)
    return rounded(ecg.variability(nn, ["record_id"], "t_ms"), "mean_nn", "sdnn", "rmssd", "tri_index")


@query("""q AS (SELECT record_id, i - lag(i, 1) OVER (PARTITION BY record_id ORDER BY i) AS d FROM series WHERE v > 40)
SELECT record_id, round(60 * 250 / avg(d), 6) AS heart_rate FROM q GROUP BY record_id""")
def heart_rate(spark, sf_dir):
    return rounded(ecg.heart_rate(series.row_index(events(spark, sf_dir)).where("v > 40"), 250), "heart_rate")


@query("""s AS (SELECT record_id, i // 16 AS segment, x FROM wave)
SELECT record_id, segment, round(avg(x), 6) AS mean, round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / var_pop(x) ** 1.5, 5) AS skewness, round(kurtosis_pop(x), 5) AS kurtosis FROM s, (SELECT 1 FROM series LIMIT 1) GROUP BY record_id, segment""")
def segment_moments(spark, sf_dir):
    out = features.moments(waves(spark, sf_dir).withColumn("segment", F.expr("i div 16")), ["record_id", "segment"], "x")
    return rounded(rounded(out, "mean"), "skewness", "kurtosis", digits=5)


@query("""d AS (SELECT record_id, i, x, x - lag(x) OVER (PARTITION BY record_id ORDER BY i) AS d FROM wave),
e AS (SELECT *, d - lag(d) OVER (PARTITION BY record_id ORDER BY i) AS e FROM d)
SELECT record_id, round(avg(sqrt(1 + d * d)), 6) AS perimeter, round(avg(abs(x)), 6) AS integral, round(avg(x * x), 6) AS power, round(sqrt(avg(x * x)), 6) AS rms, round(var_pop(x), 6) AS activity,
  round(sqrt(var_pop(d) / var_pop(x)), 6) AS mobility, round(sqrt(var_pop(e) / var_pop(d)) / sqrt(var_pop(d) / var_pop(x)), 6) AS complexity FROM e, (SELECT 1 FROM series LIMIT 1) GROUP BY record_id""")
def segment_morphology(spark, sf_dir):
    out = features.morphology(waves(spark, sf_dir), ["record_id"], "x", "i")
    return rounded(out, *[c for c in out.columns if c != "record_id"])


_PAIRS = """beats AS (SELECT vec_id, vec_id // 5 AS win, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
r AS (SELECT a.win, a.vec_id AS beat, b.vec_id AS other, corr(a.x, b.x) AS r FROM beats a JOIN beats b ON a.win = b.win AND a.i = b.i GROUP BY ALL)"""


def _correlations(spark, sf_dir):
    beats = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("win"), F.col("vec_id").alias("beat"), F.col("embedding").cast("array<double>").alias("x"))
    return ecg.beat_correlations(beats, "win", "beat", "x")


@query(_PAIRS + " SELECT win, beat, other, round(r, 6) AS r FROM r")
def beat_correlation(spark, sf_dir):
    return rounded(_correlations(spark, sf_dir), "r")


@query(_PAIRS + """, g AS (SELECT win, beat, avg(r) AS g FROM r GROUP BY ALL)
SELECT win, round(avg(g), 6) AS i_score, arg_max(beat, (round(g, 9), -beat)) AS best FROM g GROUP BY win""")
def i_score(spark, sf_dir):
    return rounded(ecg.i_score(_correlations(spark, sf_dir), "win", "beat"), "i_score")


@query("""q AS (SELECT record_id, ts_ns, v, v - lag(v) OVER (PARTITION BY record_id ORDER BY ts_ns) AS s FROM series)
SELECT record_id, ts_ns, CASE WHEN coalesce(v BETWEEN 0.02 AND 60 AND abs(s) <= 10, false) THEN 0 ELSE 1 END AS bad FROM q""")
def eda_range_slope(spark, sf_dir):
    d = series.differences(events(spark, sf_dir).drop("bad"), "v", "s")
    return d.select("record_id", "ts_ns", features.eda_flags(F.col("v"), F.col("s"), F.lit(30.0)).alias("bad"))


#: Embeddings as scanpaths: their values two by two.
_POINTS = "p AS (SELECT vec_id AS record_id, i, embedding[2 * i + 1]::DOUBLE * 100 AS x, embedding[2 * i + 2]::DOUBLE * 100 AS y FROM embeddings, (SELECT unnest(range(32)) AS i)), one AS (SELECT 1 FROM series LIMIT 1)"


def points(spark, sf_dir):
    two = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("embedding", 2 * k).alias("x"), F.get("embedding", 2 * k + 1).alias("y")))
    out = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.posexplode(two).alias("i", "p"))
    return out.select("record_id", F.col("i").cast("long").alias("i"), (F.col("p.x").cast("double") * 100).alias("x"), (F.col("p.y").cast("double") * 100).alias("y"))


@query(_POINTS + " SELECT record_id, round(2 * -ln(1 - 0.68) * 3.141592653589793 * stddev_pop(x) * stddev_pop(y) * sqrt(greatest(1 - corr(x, y) ** 2, 0)), 4) AS bcea FROM p, one GROUP BY record_id")
def bcea(spark, sf_dir):
    return rounded(features.bcea(["record_id"], points(spark, sf_dir), "x", "y"), "bcea", digits=4)


@query(_POINTS + """, s AS (SELECT record_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s FROM p WINDOW w AS (PARTITION BY record_id ORDER BY i))
SELECT record_id, round(coalesce(sum(s), 0), 4) AS path_length, round(max(s), 6) AS longest_step FROM s, one GROUP BY record_id""")
def path_length(spark, sf_dir):
    return rounded(rounded(features.path_length(points(spark, sf_dir), ["record_id"], "x", "y", "i"), "path_length", digits=4), "longest_step")


@query(_POINTS + """, m AS (SELECT a.record_id, a.i, b.i AS j FROM p a JOIN p b USING (record_id) WHERE a.i < b.i AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 12),
d AS (SELECT record_id, count(*) AS c FROM (SELECT record_id, j - i AS l, i - row_number() OVER (PARTITION BY record_id, j - i ORDER BY i) AS g FROM m) GROUP BY record_id, l, g),
v AS (SELECT record_id, count(*) AS c FROM (SELECT record_id, i AS l, j - row_number() OVER (PARTITION BY record_id, i ORDER BY j) AS g FROM m) GROUP BY record_id, l, g),
r AS (SELECT record_id, count(*) AS n FROM p GROUP BY record_id)
SELECT r.record_id, round(coalesce((SELECT count(*) FROM m WHERE m.record_id = r.record_id), 0) / (n * (n - 1) / 2), 6) AS recurrence,
  round((SELECT coalesce(sum(c) FILTER (c >= 2), 0) / sum(c) FROM d WHERE d.record_id = r.record_id), 6) AS determinism,
  round((SELECT coalesce(sum(c) FILTER (c >= 2), 0) / sum(c) FROM v WHERE v.record_id = r.record_id), 6) AS laminarity FROM r, one""")
def recurrence_lines(spark, sf_dir):
    """Recurrence, determinism and laminarity of each scanpath."""
    return rounded(gaze.recurrence_lines(points(spark, sf_dir), 12), "recurrence", "determinism", "laminarity")


@query(_POINTS + """ SELECT record_id, round(avg((sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 20)::INT), 6) AS recurrence FROM p a JOIN p b USING (record_id), one WHERE a.i < b.i GROUP BY record_id""")
def recurrence_rate(spark, sf_dir):
    return rounded(features.recurrence_rate(points(spark, sf_dir), "record_id", "x", "y", "i", 20), "recurrence")


@query("""q AS (SELECT record_id, event_type AS e, lag(event_type) OVER (PARTITION BY record_id ORDER BY ts_ns) AS p FROM series),
a AS (SELECT record_id, e, count(*) AS c FROM q GROUP BY ALL), b AS (SELECT record_id, p, e, count(*) AS c FROM q WHERE p IS NOT NULL GROUP BY ALL),
ha AS (SELECT record_id, exp(-sum(x * ln(x))) AS stationary FROM (SELECT record_id, c / sum(c) OVER (PARTITION BY record_id) AS x FROM a) GROUP BY record_id),
hb AS (SELECT record_id, exp(-sum(x * ln(x))) AS joint FROM (SELECT record_id, c / sum(c) OVER (PARTITION BY record_id) AS x FROM b) GROUP BY record_id)
SELECT record_id, round(stationary, 6) AS stationary, round(joint, 6) AS joint FROM ha LEFT JOIN hb USING (record_id) WHERE record_id IN (SELECT record_id FROM series)""")
def transition_entropy(spark, sf_dir):
    return rounded(features.transition_entropies(events(spark, sf_dir), "record_id", "event_type", "ts_ns"), "stationary", "joint")


@query("""q AS (SELECT least(floor((v - 0) / (600 / 30.0::DOUBLE)), 29)::BIGINT AS bin FROM series WHERE v BETWEEN 0 AND 600)
SELECT bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM q GROUP BY bin""")
def hist_proportion(spark, sf_dir):
    return rounded(features.histogram(events(spark, sf_dir), "v", 0, 600, 30), "proportion")


@query("""x AS (SELECT 1) SELECT event_type, round(min(v), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS high FROM series GROUP BY event_type""")
def quartiles(spark, sf_dir):
    return rounded(features.quartiles(events(spark, sf_dir), ["event_type"], "v"), "low", "q1", "median", "q3", "high")


@query("""WITH p AS (SELECT o_orderkey AS k, o_custkey % 600 AS mx, o_orderkey % 450 AS my, o_custkey % 600 + o_orderkey % 7 AS ax, o_orderkey % 450 + o_custkey % 5 AS ay, o_custkey % 600 - o_orderkey % 11 AS bx, o_orderkey % 450 - o_custkey % 90 AS by_ FROM orders),
d AS (SELECT (sqrt((ax - mx) ** 2 + (ay - my) ** 2) + sqrt((bx - mx) ** 2 + (by_ - my) ** 2)) / 2 / 750 AS d FROM p)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM d WHERE d < 0.06""")
def annotator_distance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = [k.alias("k"), (c % 600).alias("mx"), (k % 450).alias("my")]
    a = o.select(*base, (c % 600 + k % 7).alias("x"), (k % 450 + c % 5).alias("y"))
    b = o.select(*base, (c % 600 - k % 11).alias("x"), (k % 450 - c % 90).alias("y"))
    return rounded(features.annotator_distance(a, b, "k"), "mean", "sd")


@query("""f AS (SELECT (ts_ns // 3600000000000) % 100 AS frame, avg(v) AS v FROM series GROUP BY 1)
SELECT r.frame, round(f.v, 6) AS v FROM (SELECT unnest(range(120)) AS frame) r LEFT JOIN f USING (frame)""")
def frame_mean_lookup(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("frame", F.expr("ts_ns div 3600000000000") % 100)
    return rounded(series.frame_means(own, "frame", ["v"], 120), "v")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':1'), o_orderkey LIMIT 20")
def sample_topk_hash(spark, sf_dir):
    """Twenty rows without replacement: the limit is the operator."""
    return series.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 20, 1)


@query("""x AS (SELECT 1) SELECT record_id, ts_ns, v FROM series WHERE i >= floor(n * 0.1) AND i < floor(n * 0.9)""")
def middle_80pct(spark, sf_dir):
    return series.middle(events(spark, sf_dir).select("record_id", "ts_ns", "v"))


@query("""x AS (SELECT 1) SELECT record_id, max(v) AS top, arg_min(seq, seq) FILTER (v = m) AS seq FROM (SELECT *, max(v) OVER (PARTITION BY record_id) AS m FROM series) GROUP BY record_id""")
def top_per_group(spark, sf_dir):
    best = F.max(F.struct("v", -F.col("seq"))).alias("m")
    return events(spark, sf_dir).groupBy("record_id").agg(best).select("record_id", F.col("m.v").alias("top"), (-F.col("m").getField("col2")).alias("seq"))


@query("""q AS (SELECT record_id, ts_ns // 86400000000000 AS day, count(*) AS n, avg(ok) AS ok FROM series GROUP BY ALL)
SELECT record_id, day, round(sum(ok * n) OVER w / sum(n) OVER w, 6) AS cumulative FROM q WINDOW w AS (PARTITION BY record_id ORDER BY day)""")
def cumulative_valid(spark, sf_dir):
    """Running share of valid samples, day by day."""
    from pyspark.sql import Window

    day = events(spark, sf_dir).groupBy("record_id", F.expr("ts_ns div 86400000000000").alias("day")).agg(F.count("*").alias("n"), F.sum("ok").alias("k"))
    w = Window.partitionBy("record_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("record_id", "day", F.round(F.sum("k").over(w) / F.sum("n").over(w), 6).alias("cumulative"))


#: Orders at wall-clock times between one and three at night, and the nights on which Europe/Paris changes its clocks.
NIGHTS = """WITH lo AS (SELECT o_orderkey, date_trunc('day', o_orderdate) + to_seconds(3600 + o_orderkey % 7200) AS t FROM orders),
ye AS (SELECT *, make_date(year(t), 3, 31) AS m, CASE WHEN year(t) < 1996 THEN make_date(year(t), 9, 30) ELSE make_date(year(t), 10, 31) END AS o FROM lo),
ch AS (SELECT o_orderkey, t, (m - (dayofweek(m))::INT)::TIMESTAMP AS spring, (o - (dayofweek(o))::INT)::TIMESTAMP AS autumn FROM ye)"""


def _nights(spark, sf_dir):
    """(o_orderkey, day, time) as text."""
    second = F.col("o_orderkey") % 7200 + 3600
    part = lambda e, n: F.lpad(F.expr(e).cast("string"), n, "0")
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), second.alias("s"))
    time = F.concat(part("s div 3600", 2), F.lit(":"), part("s div 60 % 60", 2), F.lit(":"), part("s % 60", 2), F.lit(".000"))
    return own.select("o_orderkey", "day", time.alias("time"))


@query(NIGHTS + """ SELECT o_orderkey, (epoch_us(t) - CASE WHEN t >= spring + to_hours(3) AND t < autumn + to_hours(3) THEN 7200000000 ELSE 3600000000 END) * 1000 AS ts_ns FROM ch""")
def local_time_to_utc(spark, sf_dir):
    """dd/MM/yyyy and wall-clock time in Europe/Paris to UTC nanoseconds; a missing hour goes on from the one before, an ambiguous one is the first."""
    from ..sources.sensors import paris_to_ns

    return _nights(spark, sf_dir).select("o_orderkey", paris_to_ns(F.col("day"), F.col("time")).alias("ts_ns"))


@query("""SELECT event_id, (floor(value)::BIGINT * 60 + event_id % 60) * 1000000000::BIGINT AS ns FROM events""")
def mmss_to_ns(spark, sf_dir):
    """MM:SS texts of the events' values, minutes over 59 included."""
    from ..sources.sensors import mmss

    own = table(spark, sf_dir, "events")
    text = F.concat(F.floor("value").cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    return own.select("event_id", mmss(text).alias("ns"))


@query("""SELECT c_custkey AS a, c_name AS b, c_nationkey AS c FROM customer""")
def csv_repair(spark, sf_dir):
    """Doubled separators in CSV lines, mended while they are read."""
    from ..sources.sensors import repaired

    lines = table(spark, sf_dir, "customer").select(F.concat_ws(",,", "c_custkey", "c_name", "c_nationkey").alias("value"))
    return repaired(lines, "a BIGINT, b STRING, c BIGINT")


@query("""x AS (SELECT 1) SELECT record_id, count(*) AS n, round(sum(v), 4) AS total FROM series GROUP BY record_id""")
def record_bundle(spark, sf_dir):
    """Write records as partitioned Parquet and read them again."""
    from ..sources.sensors import bundle

    out = bundle(events(spark, sf_dir).withColumn("part", F.pmod("record_id", F.lit(4))), "part")
    return out.groupBy("record_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


#: R peaks of the strips at 40 samples a second: filters, candidates, the decision by recursion over them, the highest sample around.
BEATS = STRIPS + """,
bs1 AS (SELECT record_id, i, x, sum(x) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s FROM strip),
blo AS (SELECT record_id, i, sum(s) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS low FROM bs1),
bu AS (SELECT *, (CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS sg, 32 * coalesce(lag(low, 16) OVER w, 0) + coalesce(lag(low, 32) OVER w, 0) - low AS uu FROM blo WINDOW w AS (PARTITION BY record_id ORDER BY i)),
bhi AS (SELECT *, sg * sum(sg * uu) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM bu),
bba AS (SELECT record_id, i, high / greatest(max(high) OVER w, -min(high) OVER w) AS band FROM bhi WINDOW w AS (PARTITION BY record_id)),
bde AS (SELECT *, (CASE WHEN i >= 2 THEN -2 * lag(band) OVER w - lag(band, 2) OVER w WHEN i = 1 THEN -2 * lag(band) OVER w ELSE 0 END + 2 * coalesce(lead(band) OVER w, 0) + coalesce(lead(band, 2) OVER w, 0)) * 40 / 8 AS de FROM bba WINDOW w AS (PARTITION BY record_id ORDER BY i)),
bit AS (SELECT record_id, i, band, sum(de * de) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS g FROM bde),
bsm AS (SELECT *, sum(g) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25 AS sm FROM bit),
bpk AS (SELECT *, coalesce(i >= 21 AND sm > lag(sm) OVER w AND sm > lead(sm) OVER w, false)::INT AS peak, CASE WHEN lead(i) OVER w IS NOT NULL THEN band END AS inner_band, g - lag(g) OVER w AS d FROM bsm WINDOW w AS (PARTITION BY record_id ORDER BY i)),
bfr AS (SELECT *, max(d) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS slope,
  coalesce(sum(peak) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM bpk),
bgx AS (SELECT record_id, gap, max(g) AS bx, arg_max(i, (g, -i)) AS x FROM bfr GROUP BY record_id, gap),
bca AS (SELECT f.record_id, f.gap AS k, f.i AS p, f.g AS m, f.slope, x.bx, x.x,
    (SELECT max(band) FROM bit a WHERE a.record_id = f.record_id AND a.i BETWEEN f.i - 6 AND f.i + 5 AND a.i < n.last) AS b,
    (SELECT arg_max(i, (band, -i)) FROM bit a WHERE a.record_id = f.record_id AND a.i BETWEEN f.i - 6 AND f.i + 5 AND a.i < n.last) AS r,
    (SELECT max(band) FROM bit a WHERE a.record_id = f.record_id AND a.i BETWEEN x.x - 6 AND x.x - 1) AS bb,
    (SELECT arg_max(i, (band, -i)) FROM bit a WHERE a.record_id = f.record_id AND a.i BETWEEN x.x - 6 AND x.x - 1) AS bp
  FROM bfr f JOIN bgx x USING (record_id, gap) JOIN (SELECT record_id, max(i) AS last FROM strip GROUP BY record_id) n USING (record_id) WHERE peak = 1),
bdc AS (WITH RECURSIVE t AS (
  SELECT record_id, -1::BIGINT AS k, 0::BIGINT AS prev, 0::DOUBLE AS ps, 0::DOUBLE AS low, 0::DOUBLE AS high, 0::DOUBLE AS missed, 0::DOUBLE AS spki, 0::DOUBLE AS npki, 0::DOUBLE AS spkf, 0::DOUBLE AS npkf,
    0::DOUBLE AS i1, 0::DOUBLE AS f1, 0::DOUBLE AS f2, []::DOUBLE[] AS rr, []::DOUBLE[] AS rr2, []::BIGINT[] AS found FROM (SELECT DISTINCT record_id FROM bca)
  UNION ALL
  SELECT record_id, k, p, slope, low, high, missed, spki, npki, spkf, npkf, npki + 0.25 * (spki - npki), npkf + 0.25 * (spkf - npkf), 0.5 * (npkf + 0.25 * (spkf - npkf)), rr, rr2, found FROM (
  SELECT record_id, k, p, slope, low, high, missed, rr, rr2, CASE WHEN strong THEN 0.125 * m + 0.875 * spki ELSE spki END AS spki, CASE WHEN NOT strong THEN 0.125 * m + 0.875 * npki ELSE npki END AS npki,
    CASE WHEN strong AND hf THEN 0.125 * b + 0.875 * spkf ELSE spkf END AS spkf, CASE WHEN (NOT strong AND NOT wave) OR (strong AND NOT hf) THEN 0.125 * b + 0.875 * npkf ELSE npkf END AS npkf,
    CASE WHEN strong AND hf THEN list_append(found, r) ELSE found END AS found FROM (
  SELECT *, over1 AND NOT wave AS strong FROM (
  SELECT *, m >= i1 AS over1, m >= i1 AND coalesce(rrn > 0.2 AND rrn < 0.36 AND slope < 0.5 * ps, false) AS wave, b > f1 AS hf FROM (
  SELECT * REPLACE (CASE WHEN back THEN npki + 0.25 * (spki - npki) ELSE i1 END AS i1, CASE WHEN deep THEN npkf + 0.25 * (spkf - npkf) ELSE f1 END AS f1, CASE WHEN deep THEN list_append(found, bp) ELSE found END AS found) FROM (
  SELECT * REPLACE (CASE WHEN back THEN 0.25 * bx + 0.75 * spki ELSE spki END AS spki, CASE WHEN deep THEN 0.25 * bb + 0.75 * spkf ELSE spkf END AS spkf) FROM (
  SELECT *, back AND coalesce(bb > f1 AND bb > f2, false) AS deep FROM (
  SELECT *, coalesce(rrn > missed AND bx > i1, false) AS back FROM (
  SELECT * REPLACE (i1 / CASE WHEN coalesce(mean1 < low OR mean1 > missed, false) THEN 2 ELSE 1 END AS i1, f1 / CASE WHEN coalesce(mean1 < low OR mean1 > missed, false) THEN 2 ELSE 1 END AS f1) FROM (
  SELECT * REPLACE (CASE WHEN moves THEN 0.92 * mean2 ELSE low END AS low, CASE WHEN moves THEN 1.16 * mean2 ELSE high END AS high, CASE WHEN moves THEN 1.66 * mean2 ELSE missed END AS missed) FROM (
  SELECT *, k > 0 AND (len(rr2) > 7 OR k < 8) AS moves FROM (
  SELECT * REPLACE (both_[-8:] AS rr2), CASE WHEN len(fits) > 0 AND len(both_) > 8 THEN list_avg(both_[-8:]) ELSE mean1 END AS mean2 FROM (
  SELECT *, list_concat(rr2, fits) AS both_, CASE WHEN k > 0 THEN list_avg(rr) END AS mean1 FROM (
  SELECT *, CASE WHEN k >= 8 THEN list_filter(rr, lambda v: v > low AND v < high) ELSE []::DOUBLE[] END AS fits FROM (
  SELECT * REPLACE (CASE WHEN k > 0 THEN list_append(rr, rrn)[-8:] ELSE rr END AS rr) FROM (
  SELECT t.* EXCLUDE (k), c.* EXCLUDE (record_id), CASE WHEN c.k > 0 THEN (c.p - t.prev) / 40.0::DOUBLE END AS rrn FROM t JOIN bca c ON c.record_id = t.record_id AND c.k = t.k + 1
  ))))))))))))))))
  SELECT record_id, found FROM t QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY k DESC) = 1),
beat AS (SELECT DISTINCT record_id, (SELECT arg_max(s.i, (s.x, -s.i)) FROM strip s WHERE s.record_id = f.record_id AND s.i BETWEEN f.r - 8 AND f.r + 8) AS i FROM (SELECT record_id, unnest(found) AS r FROM bdc) f)"""


@query("WITH " + BEATS + " SELECT record_id, i FROM beat")
def qrs_peaks(spark, sf_dir):
    """R peaks of each strip."""
    return ecg.r_peaks(strips(spark, sf_dir), "x", 40)


_NN = """z AS (SELECT event_type || ':' || (ts_ns // 864000000000000)::VARCHAR AS record_id, ts_ns, 600 + v AS nn FROM series),
cu AS (SELECT record_id, ts_ns, nn, floor(sum(nn) OVER (PARTITION BY record_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) / 300000)::BIGINT AS segment FROM z),
nn AS (SELECT record_id, segment, row_number() OVER (PARTITION BY record_id, segment ORDER BY ts_ns) - 1 AS k, nn FROM cu)"""


def nn_series(spark, sf_dir):
    """Events of one type and ten days as intervals of 600 ms and their value, by five minutes."""
    own = events(spark, sf_dir)
    record = F.concat_ws(":", "event_type", F.expr("ts_ns div 864000000000000").cast("string"))
    return hrv.by_minutes(own.select(record.alias("record_id"), "ts_ns", (600 + F.col("v")).alias("nn")), "ts_ns")


@query(_NN + """,
ru AS (SELECT record_id, segment, k, nn AS a, lead(nn) OVER w AS b, lead(nn, 2) OVER w AS c, 0.2 * stddev_pop(nn) OVER (PARTITION BY record_id, segment) AS r FROM nn WINDOW w AS (PARTITION BY record_id, segment ORDER BY k)),
me AS (SELECT x.record_id, x.segment, x.k, count(*) AS two, count(*) FILTER (abs(x.c - y.c) <= x.r) AS three, max((x.c IS NOT NULL)::INT) AS full_ FROM ru x JOIN ru y ON x.record_id = y.record_id AND x.segment = y.segment
  WHERE x.b IS NOT NULL AND y.b IS NOT NULL AND abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r GROUP BY ALL),
m2 AS (SELECT *, count(*) OVER w AS n2, sum(full_) OVER w AS n3 FROM me WINDOW w AS (PARTITION BY record_id, segment)),
ap AS (SELECT record_id, segment, CASE WHEN max(n3) > 0 THEN avg(ln(two / n2)) - avg(ln(three / n3)) FILTER (full_ = 1) END AS apen FROM m2 GROUP BY record_id, segment),
yy AS (SELECT record_id, segment, k, n, sum(d) OVER (PARTITION BY record_id, segment ORDER BY k ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT *, nn - avg(nn) OVER (PARTITION BY record_id, segment) AS d, count(*) OVER (PARTITION BY record_id, segment) AS n FROM nn)),
bo AS (SELECT record_id, segment, size, k // size AS box, regr_syy(y, k) - regr_sxy(y, k) ** 2 / regr_sxx(y, k) AS sse FROM yy, (SELECT unnest(range(4, 65)) AS size) WHERE (k // size + 1) * size <= n GROUP BY ALL),
fl AS (SELECT record_id, segment, size, 0.5 * ln(sum(greatest(sse, 0)) / (count(*) * size) + 1e-300) AS f FROM bo GROUP BY record_id, segment, size),
al AS (SELECT record_id, segment, CASE WHEN count(*) FILTER (size <= 16) > 1 THEN regr_slope(f, ln(size)) FILTER (size <= 16) END AS alpha1, CASE WHEN count(*) FILTER (size > 16) > 1 THEN regr_slope(f, ln(size)) FILTER (size > 16) END AS alpha2 FROM fl GROUP BY ALL),
ti AS (SELECT record_id, segment, k, nn, round_even(sum(CASE WHEN k > 0 THEN nn ELSE 0 END) OVER (PARTITION BY record_id, segment ORDER BY k ROWS UNBOUNDED PRECEDING) * 1000, 0)::BIGINT AS t FROM nn),
iv AS (SELECT *, lag(t) OVER w AS t0, lag(nn) OVER w AS y0 FROM ti WINDOW w AS (PARTITION BY record_id, segment ORDER BY k)),
gr AS (SELECT record_id, segment, t, t0, nn, y0, unnest(range(coalesce(t0 // 250000 + 1, 0), t // 250000 + 1)) AS g FROM iv),
ev AS (SELECT record_id, segment, g, CASE WHEN t0 IS NULL THEN nn ELSE y0 + (nn - y0) * (g * 250000 - t0) / (t - t0)::DOUBLE END AS y FROM gr),
ec AS (SELECT record_id, segment, g, y, n, least(n, 256) AS size, least(n, 256) // 2 AS hop FROM (SELECT *, count(*) OVER (PARTITION BY record_id, segment) AS n FROM ev) WHERE n > 2),
wi AS (SELECT record_id, segment, size, wd, g - wd * hop AS j, y - avg(y) OVER (PARTITION BY record_id, segment, wd) AS y, 0.5 - 0.5 * cos(2 * pi() * (g - wd * hop) / size) AS h
  FROM (SELECT *, unnest(range(0, (n - size) // hop + 1)) AS wd FROM ec) WHERE g >= wd * hop AND g < wd * hop + size),
sp AS (SELECT record_id, segment, size, wd, bin, 2 * (sum(y * h * cos(2 * pi() * j * bin / size)) ** 2 + sum(y * h * sin(2 * pi() * j * bin / size)) ** 2) / (4 * sum(h * h)) * 4 / size AS p
  FROM (SELECT *, unnest(range((size * 4 + 399) // 400, (size * 40 + 399) // 400)) AS bin FROM wi) GROUP BY record_id, segment, size, wd, bin),
pw AS (SELECT record_id, segment, sum(p) FILTER (bin * 400 < size * 15) AS lf, sum(p) FILTER (bin * 400 >= size * 15) AS hf FROM (SELECT record_id, segment, size, bin, avg(p) AS p FROM sp GROUP BY ALL) GROUP BY ALL),
co AS (SELECT record_id, segment, count(*) AS n FROM nn GROUP BY ALL)
SELECT record_id, segment, n, round(apen, 6) AS apen, round(alpha1, 6) AS alpha1, round(alpha2, 6) AS alpha2, round(lf, 4) AS lf, round(hf, 4) AS hf, round(lf / nullif(hf, 0), 6) AS ratio
FROM co LEFT JOIN ap USING (record_id, segment) LEFT JOIN al USING (record_id, segment) LEFT JOIN pw USING (record_id, segment)""")
def hrv_nonlinear(spark, sf_dir):
    """Approximate entropy, detrended fluctuation and band powers of intervals, by five minutes."""
    out = hrv.nonlinear(nn_series(spark, sf_dir))
    return rounded(rounded(out, "apen", "alpha1", "alpha2", "ratio"), "lf", "hf", digits=4)


@query("""k AS (SELECT record_id, i, x FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM wave WINDOW w AS (PARTITION BY record_id ORDER BY i)) WHERE x > a AND x > b),
l AS (SELECT record_id, list(i ORDER BY x DESC, i) AS ps FROM k GROUP BY record_id),
r AS (WITH RECURSIVE t AS (SELECT record_id, ps, 0 AS k, []::BIGINT[] AS kept FROM l
  UNION ALL SELECT record_id, ps, k + 1, CASE WHEN len(kept) = 0 OR list_min(list_transform(kept, lambda q: abs(q - ps[k + 1]))) >= 5 THEN list_append(kept, ps[k + 1]) ELSE kept END FROM t WHERE k < len(ps))
  SELECT record_id, unnest(kept) AS i FROM t WHERE k = len(ps))
SELECT record_id, i FROM (SELECT r.record_id, r.i, x, max(x) OVER (PARTITION BY r.record_id) AS top FROM r JOIN k USING (record_id, i)), (SELECT 1 FROM series LIMIT 1) WHERE x >= 0.005 * top""")
def peak_suppression(spark, sf_dir):
    return kernels.suppressed_peaks(waves(spark, sf_dir), "x", distance=5, share=0.005)


def _turned(before: str, bit: int, after: str) -> str:
    """One step along a Hilbert curve of 16 cells a side."""
    turn = lambda own, other: f"CASE WHEN (y & {bit}) > 0 THEN {own} WHEN (x & {bit}) > 0 THEN 15 - {other} ELSE {other} END AS {own}"
    quarter = f"CASE WHEN (x & {bit}) > 0 THEN CASE WHEN (y & {bit}) > 0 THEN 2 ELSE 3 END ELSE CASE WHEN (y & {bit}) > 0 THEN 1 ELSE 0 END END"
    return f"{after} AS (SELECT record_id, i, {turn('x', 'y')}, {turn('y', 'x')}, d + {bit * bit} * {quarter} AS d FROM {before})"


_HILBERT = _POINTS + """, h0 AS (SELECT record_id, i, greatest(least(floor((x + 60) / 120 * 16), 15), 0)::INT AS x, greatest(least(floor((y + 60) / 120 * 16), 15), 0)::INT AS y, 0 AS d FROM p),
""" + ",\n".join(_turned(f"h{k}", 8 >> k, f"h{k + 1}") for k in range(4))


def _placed(spark, sf_dir):
    """Points with their place on the Hilbert curve."""
    place = scanpath.hilbert(scanpath.on_grid(F.col("x"), -60, 60), scanpath.on_grid(F.col("y"), -60, 60))
    return points(spark, sf_dir).withColumn("d", place)


@query(_HILBERT + " SELECT record_id, i, d FROM h4, one")
def hilbert_order(spark, sf_dir):
    """Place of each fixation on a Hilbert curve of four iterations."""
    return _placed(spark, sf_dir).select("record_id", "i", "d")


_SHIFTED = """ms AS (WITH RECURSIVE t AS (
  SELECT record_id, i, x AS mx, y AS my, 0 AS r, true AS moves FROM p
  UNION ALL
  SELECT record_id, i, nx, ny, r + 1, greatest(abs(nx - mx), abs(ny - my)) >= 1e-6 FROM (
    SELECT t.record_id, t.i, any_value(t.mx) AS mx, any_value(t.my) AS my, any_value(t.r) AS r, avg(p.x) AS nx, avg(p.y) AS ny
    FROM t JOIN p ON t.record_id = p.record_id AND (t.mx - p.x) ** 2 + (t.my - p.y) ** 2 <= 625 WHERE t.moves AND t.r < 50 GROUP BY t.record_id, t.i))
  SELECT record_id, i, round(mx, 6) AS mx, round(my, 6) AS my FROM t QUALIFY row_number() OVER (PARTITION BY record_id, i ORDER BY r DESC) = 1),
mo AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY first) AS k FROM (SELECT record_id, mx, my, min(i) AS first FROM ms GROUP BY ALL)),
ce AS (WITH RECURSIVE c AS (
  SELECT record_id, 0::BIGINT AS k, []::STRUCT(a DOUBLE, b DOUBLE)[] AS cs FROM (SELECT DISTINCT record_id FROM mo)
  UNION ALL
  SELECT c.record_id, c.k + 1, CASE WHEN len(list_filter(cs, lambda s: (s.a - mx) ** 2 + (s.b - my) ** 2 <= 625)) > 0 THEN cs ELSE list_append(cs, {'a': mx, 'b': my}) END FROM c JOIN mo ON mo.record_id = c.record_id AND mo.k = c.k + 1)
  SELECT record_id, cs FROM c QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY k DESC) = 1),
ar AS (SELECT ms.record_id, ms.i, list_position(list_transform(cs, lambda s: (s.a - mx) ** 2 + (s.b - my) ** 2 <= 625), true) - 1 AS area FROM ms JOIN ce USING (record_id))"""

#: Phrases of the words wo(record_id, w).
_PHRASES = """lz AS (WITH RECURSIVE z AS (
  SELECT record_id, w, 0::BIGINT AS pos, 1::BIGINT AS size, 0::BIGINT AS n FROM wo
  UNION ALL
  SELECT record_id, w, CASE WHEN hit THEN pos ELSE pos + size END, CASE WHEN hit THEN size + 1 ELSE 1 END, CASE WHEN hit THEN n ELSE n + 1 END
  FROM (SELECT *, pos + size <= length(w) AND strpos(substr(w, 1, pos + size - 1), substr(w, pos + 1, size)) > 0 AS hit FROM z WHERE pos < length(w)))
  SELECT record_id, max(n) AS lempel_ziv FROM z GROUP BY record_id)"""


@query(_POINTS + ", " + _SHIFTED + " SELECT record_id, i, area FROM ar, one")
def gaze_areas(spark, sf_dir):
    """Area of interest of each fixation, by mean shift."""
    return scanpath.mean_shift(points(spark, sf_dir), ["record_id"], "i", 25.0).select("record_id", "i", "area")


@query("wo AS (SELECT record_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts_ns) AS w FROM series GROUP BY record_id), " + _PHRASES + " SELECT record_id, lempel_ziv FROM lz")
def sequence_complexity(spark, sf_dir):
    """Phrases of each record's sequence of events (by their first letters)."""
    own = events(spark, sf_dir).select("record_id", "ts_ns", F.substring("event_type", 1, 1).alias("letter"))
    return scanpath.lempel_ziv(own, ["record_id"], "letter", "ts_ns")


@query(_HILBERT + ", " + _SHIFTED + """, wo AS (SELECT record_id, string_agg(chr((97 + area)::INT), '' ORDER BY i) AS w FROM ar GROUP BY record_id), """ + _PHRASES + """,
sa AS (SELECT a.record_id, k, a.i % k AS m, sum(abs(a.d - b.d)) AS s FROM h4 a, (SELECT unnest(range(1, 11)) AS k) JOIN h4 b ON b.record_id = a.record_id AND b.i = a.i - k WHERE 32 > 2 * k GROUP BY ALL),
le AS (SELECT record_id, k, ln(avg(s * 31 / (((31 - m) // k) * k * k)) + 1e-300) AS l FROM sa GROUP BY record_id, k),
fd AS (SELECT record_id, regr_slope(l, -ln(k)) AS fractal_dimension FROM le GROUP BY record_id),
he AS (SELECT a.record_id, sum(a.x * b.y - b.x * a.y) / 2 AS hull_area FROM p a JOIN p b ON a.record_id = b.record_id AND a.i <> b.i
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.record_id = a.record_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-9) GROUP BY a.record_id),
na AS (SELECT record_id, max(area) + 1 AS n_areas FROM ar GROUP BY record_id)
SELECT record_id, round(hull_area, 4) AS hull_area, round(fractal_dimension, 6) AS fractal_dimension, n_areas, lempel_ziv FROM he JOIN fd USING (record_id) JOIN na USING (record_id) JOIN lz USING (record_id), one""")
def scanpath_kernels(spark, sf_dir):
    """Hull area, fractal dimension of the order along a Hilbert curve, areas of interest and the complexity of their sequence."""
    own = _placed(spark, sf_dir)
    areas = scanpath.mean_shift(own.select("record_id", "i", "x", "y"), ["record_id"], "i", 25.0)
    out = areas.groupBy("record_id").agg((F.max("area") + 1).alias("n_areas"))
    for more in (kernels.hulls(own, "record_id"), scanpath.higuchi(own, ["record_id"], "d", "i"), scanpath.lempel_ziv(areas, ["record_id"], "area", "i")):
        out = out.join(more, "record_id")
    return rounded(rounded(out, "fractal_dimension"), "hull_area", digits=4)


_STATES = _POINTS + """, sp AS (SELECT record_id, i, x, y, coalesce(sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) * 200, 0) AS v FROM p WINDOW w AS (PARTITION BY record_id ORDER BY i)),
ve AS (SELECT record_id, list(v ORDER BY i) AS v, median(v) AS m FROM sp GROUP BY record_id),
vi AS (WITH RECURSIVE t AS (
  SELECT record_id, v, list_transform(v, lambda u: (u <= m)::INT) AS s, 0 AS r, false AS done FROM ve
  UNION ALL
  SELECT record_id, v, s2, r + 1, s2 = s FROM (
  SELECT *, list_transform(list_reverse(list_reduce(list_concat([[(ds[-1] < 0)::INT::DOUBLE]], list_transform(list_reverse(ds)[2:], lambda d: [d])),
      lambda a, b: list_append(a, (b[1] < CASE WHEN a[-1] = 1 THEN ln(0.95 / 0.05) ELSE -ln(0.95 / 0.05) END)::INT::DOUBLE))), lambda z: z::INT) AS s2 FROM (
  SELECT *, list_reduce(list_transform(v, lambda u: [((u - m1) ** 2 / (2 * s1) + 0.5 * ln(s1)) - ((u - m0) ** 2 / (2 * s0) + 0.5 * ln(s0))]),
      lambda a, b: list_append(a, greatest(least(a[-1], ln(0.95 / 0.05)), -ln(0.95 / 0.05)) + b[1])) AS ds FROM (
  SELECT *, list_avg(list_transform(one_, lambda u: (u - m1) ** 2)) + 1e-9 AS s1, list_avg(list_transform(zero, lambda u: (u - m0) ** 2)) + 1e-9 AS s0 FROM (
  SELECT *, list_avg(one_) AS m1, list_avg(zero) AS m0 FROM (
  SELECT *, list_filter(v, lambda u, k: s[k] = 1) AS one_, list_filter(v, lambda u, k: s[k] = 0) AS zero FROM t WHERE NOT done AND r < 20 AND list_contains(s, 0) AND list_contains(s, 1)))))))
  SELECT record_id, s FROM t QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY r DESC) = 1),
la AS (SELECT sp.*, s[i + 1] AS slow FROM sp JOIN vi USING (record_id)),
ru AS (SELECT *, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS g FROM la WHERE slow = 1)"""


@query(_STATES + """ SELECT record_id, min(i) AS first, max(i) AS last, round(count(*) / 200.0, 6) AS duration_s, round(avg(x), 4) AS x, round(avg(y), 4) AS y,
  round(sqrt((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2), 4) AS drift, round(avg(v), 3) AS mean_speed FROM ru, one GROUP BY record_id, g""")
def fixations(spark, sf_dir):
    """Two-state labels of gaze speed, and what each fixation is like."""
    out = gaze.fixations(points(spark, sf_dir), "record_id", "i", rate=200.0)
    return rounded(rounded(rounded(out, "duration_s"), "x", "y", "drift", digits=4), "mean_speed", digits=3)


@query()
def sparse_decomposition(spark, sf_dir):
    """Tonic level and sparse driver of each wave."""
    return skin.totals(waves(spark, sf_dir), "x", rate=4.0)


@query()
def skin_series(spark, sf_dir):
    """Tonic and phasic part, driver and squared rest of each sample of the strips, the phasic part over its 0.995 quantile too."""
    return skin.scaled(skin.series(strips(spark, sf_dir), "x", 4.0))


@query("WITH " + STRIPS + """,
k AS (SELECT record_id, i, x - 0.15 AS d FROM strip WHERE x > 0.15),
l AS (SELECT record_id, list(i ORDER BY d DESC, i) AS ps FROM k GROUP BY record_id),
r AS (WITH RECURSIVE t AS (SELECT record_id, ps, 0 AS k, []::BIGINT[] AS kept FROM l
  UNION ALL SELECT record_id, ps, k + 1, CASE WHEN len(kept) = 0 OR list_min(list_transform(kept, lambda q: abs(q - ps[k + 1]))) >= 8 THEN list_append(kept, ps[k + 1]) ELSE kept END FROM t WHERE k < len(ps))
  SELECT record_id, unnest(kept) AS i FROM t WHERE k = len(ps)),
e AS (SELECT record_id, i FROM (SELECT r.record_id, r.i, d, max(d) OVER (PARTITION BY r.record_id) AS top FROM r JOIN k USING (record_id, i)) WHERE d >= 0.2 * top),
b AS (SELECT record_id, i // 480 AS block, count(*) AS n FROM strip GROUP BY ALL),
c AS (SELECT record_id, i // 480 AS block, count(*) AS n FROM e GROUP BY ALL)
SELECT b.record_id, b.block, round(coalesce(c.n, 0) / 120.0, 6) AS frequency FROM b LEFT JOIN c ON b.record_id = c.record_id AND b.block = c.block WHERE b.n = 480""")
def driver_rates(spark, sf_dir):
    """Events a second in each 120 s of a driver, two seconds apart and at least a fifth of the highest."""
    own = strips(spark, sf_dir).withColumn("driver", F.greatest(F.col("x") - 0.15, F.lit(0.0)))
    return rounded(skin.event_rates(own, skin.events(own, 8, 0.2), 4.0), "frequency")


@query("""m AS (SELECT record_id, i, (x - avg(x) OVER (PARTITION BY record_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS y FROM wave),
f AS (SELECT record_id, k, (sum(y * cos(2 * pi() * i * k / 64)) ** 2 + sum(y * sin(2 * pi() * i * k / 64)) ** 2) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (64 * 24.0) AS p FROM m, (SELECT unnest(range(33)) AS k) GROUP BY record_id, k)
SELECT record_id, round(sum(p), 6) AS power, arg_max(k, round(p, 9))::DOUBLE AS peak_hz FROM f, (SELECT 1 FROM series LIMIT 1) GROUP BY record_id""")
def spectrum_bands(spark, sf_dir):
    return rounded(kernels.welch(waves(spark, sf_dir), "x", rate=64.0), "power")


from . import signals  # noqa: E402,F401  registers its queries here

"""Queries of gaze ingest, data checks, quality decisions, eye movements and feature tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import all_of, clip_to_null, enough, finite, in_bounds, inside_open, present, rescaled, wall_clock
from ..operators import ecg, features, gaze, quality, series
from ..session import shared_dir
from ..sources import bundles, sensors
from .catalog import _PAIRS, _POINTS, BEATS, HOUR, NIGHTS, _correlations, _nights, events, points, query, rounded, strips, table, waves

#: Events as mapped gaze: coordinates beyond the frame, missing mappings and few matches included.
_GAZE = """gz AS (SELECT record_id, ts_ns, i, seq, v * 10 AS gx, (seq * 37 % 1500)::DOUBLE AS gy, CASE WHEN seq % 11 <> 0 THEN v * 2 END AS rx, (seq * 13 % 500)::DOUBLE AS ry,
  CASE WHEN seq % 7 <> 0 THEN seq % 25 END AS matches FROM series)"""


def _gaze(spark, sf_dir):
    own = series.row_index(events(spark, sf_dir))
    s = F.col("seq")
    return own.select("record_id", "ts_ns", "i", "seq", (F.col("v") * 10).alias("gx"), (s * 37 % 1500).cast("double").alias("gy"), F.when(s % 11 != 0, F.col("v") * 2).alias("rx"), (s * 13 % 500).cast("double").alias("ry"), F.when(s % 7 != 0, s % 25).alias("matches"))


@query(_GAZE + """ SELECT record_id, ts_ns, CASE WHEN gx <= 1600 THEN gx END AS gx, CASE WHEN gy <= 1200 THEN gy END AS gy, (gx <= 1600 AND gy <= 1200)::INT AS status,
  (rx IS NOT NULL AND coalesce(matches, 0) >= 10)::INT AS mapped, (coalesce(rx BETWEEN 0 AND 600, true) AND ry BETWEEN 0 AND 450)::INT AS in_bounds,
  (rx IS NOT NULL AND coalesce(matches, 0) >= 10 AND coalesce(rx BETWEEN 0 AND 600, true) AND ry BETWEEN 0 AND 450)::INT AS mapped_status FROM gz""")
def gaze_flags(spark, sf_dir):
    """Clipped coordinates, mapping and bounds flags, and their conjunction."""
    g = _gaze(spark, sf_dir).withColumns({"gx": clip_to_null(F.col("gx"), 1600), "gy": clip_to_null(F.col("gy"), 1200)})
    g = g.withColumn("status", present(F.col("gx"), F.col("gy"))).withColumn("mapped", all_of(present(F.col("rx"), F.col("ry")), enough(F.col("matches"), 10)))
    g = g.withColumn("in_bounds", in_bounds(F.col("rx"), F.col("ry"), 600, 450))
    return g.select("record_id", "ts_ns", "gx", "gy", "status", "mapped", "in_bounds", all_of(F.col("mapped"), F.col("in_bounds")).alias("mapped_status"))


@query(_GAZE + " SELECT record_id, ts_ns, rx, matches FROM gz WHERE rx IS NOT NULL AND matches IS NOT NULL")
def complete_rows(spark, sf_dir):
    """Rows without any null."""
    return _gaze(spark, sf_dir).select("record_id", "ts_ns", "rx", "matches").dropna(how="any")


_BOUNDS = "bo AS (SELECT record_id, min(ts_ns) FILTER (i = 5) AS a, min(ts_ns) FILTER (i = 20) AS b FROM series GROUP BY record_id)"


def _bounds(own):
    at = lambda k: F.min(F.when(F.col("i") == k, F.col("ts_ns")))
    return own.groupBy("record_id").agg(at(5).alias("start_ns"), at(20).alias("end_ns"))


@query(_BOUNDS + " SELECT s.record_id, s.ts_ns, s.v FROM series s JOIN bo USING (record_id) WHERE ts_ns BETWEEN a AND b")
def range_inclusive(spark, sf_dir):
    """Samples from one time through another."""
    own = series.row_index(events(spark, sf_dir))
    return quality.between_closed(own.select("record_id", "ts_ns", "v"), _bounds(own))


@query(_BOUNDS + " SELECT s.record_id, s.ts_ns, s.v FROM series s JOIN bo USING (record_id) WHERE ts_ns > a AND ts_ns <= b")
def range_half_open(spark, sf_dir):
    """Samples after one time through another."""
    own = series.row_index(events(spark, sf_dir))
    return quality.after_until(own.select("record_id", "ts_ns", "v"), _bounds(own))


@query(_GAZE + """ SELECT DISTINCT record_id, (ts_ns // 3600000000000) AS frame FROM gz WHERE matches >= 15 AND rx > 0 AND rx < 600 AND ry > 0 AND ry < 450""")
def well_matched_frames(spark, sf_dir):
    """Distinct frames of points strictly inside the image with matches enough, in order."""
    g = _gaze(spark, sf_dir).where((F.col("matches") >= 15) & inside_open(F.col("rx"), F.col("ry"), 600, 450))
    return g.select("record_id", F.expr("ts_ns div 3600000000000").alias("frame")).distinct().orderBy("record_id", "frame")


@query(_GAZE + """, u AS (SELECT record_id, 'rx' AS "column", avg((rx IS NULL)::INT) AS share FROM gz GROUP BY record_id UNION ALL SELECT record_id, 'matches', avg((matches IS NULL)::INT) FROM gz GROUP BY record_id)
SELECT record_id, "column", round(share, 6) AS share, share < 0.1 AS ok FROM u""")
def null_share_check(spark, sf_dir):
    return rounded(quality.null_shares(_gaze(spark, sf_dir), ["rx", "matches"], 0.1), "share")


@query("""e AS (SELECT record_id, min(ts_ns) AS a0, max(ts_ns) AS a1 FROM series WHERE event_type = 'click' GROUP BY record_id), f AS (SELECT record_id, min(ts_ns) AS b0, max(ts_ns) AS b1 FROM series WHERE event_type = 'error' GROUP BY record_id)
SELECT record_id, greatest(coalesce(CASE WHEN a0 IS NULL OR b0 IS NULL THEN 0 ELSE least(a1, b1) - greatest(a0, b0) END, 0), 0)::BIGINT AS overlap_ns,
  coalesce(CASE WHEN a0 IS NULL OR b0 IS NULL THEN 0 ELSE least(a1, b1) - greatest(a0, b0) END, 0) > 0 AS ok FROM e FULL JOIN f USING (record_id)""")
def span_overlap_check(spark, sf_dir):
    own = events(spark, sf_dir)
    return quality.span_overlaps(own.where("event_type = 'click'"), own.where("event_type = 'error'"))


@query(NIGHTS + """ SELECT o_orderkey, CASE WHEN t >= spring + to_hours(2) AND t < spring + to_hours(3) THEN 'missing' WHEN t >= autumn + to_hours(2) AND t < autumn + to_hours(3) THEN 'ambiguous' ELSE 'ok' END AS clock FROM ch""")
def time_zone_check(spark, sf_dir):
    """Whether the wall-clock times of all orders, at night, are there once in Europe/Paris."""
    return _nights(spark, sf_dir).select("o_orderkey", wall_clock(F.col("day"), F.col("time"), "Europe/Paris").alias("clock"))


@query(_GAZE + """, o AS (SELECT record_id, ts_ns, CASE WHEN seq % 5 = 0 THEN 'nan'::DOUBLE ELSE rx END AS rx, ry FROM gz)
SELECT record_id, ts_ns, round(rx / 600 * 4080, 6) AS px, round(ry / 450 * 3060, 6) AS py FROM o WHERE rx IS NOT NULL AND NOT isnan(rx) AND rx BETWEEN 0 AND 600 AND ry BETWEEN 0 AND 450""")
def finite_points(spark, sf_dir):
    """Finite points inside the image, in its pixels."""
    g = _gaze(spark, sf_dir).withColumn("rx", F.when(F.col("seq") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("rx")))
    g = g.where(finite(F.col("rx"), F.col("ry"))).where((in_bounds(F.col("rx"), F.col("ry"), 600, 450)) == 1)
    return rounded(g.select("record_id", "ts_ns", rescaled(F.col("rx"), 600, 4080).alias("px"), rescaled(F.col("ry"), 450, 3060).alias("py")), "px", "py")


@query("""q AS (SELECT record_id, i, x AS f, lag(x) OVER w AS f0, lead(x) OVER w AS f1 FROM wave WINDOW w AS (PARTITION BY record_id ORDER BY i))
SELECT record_id, round(avg(CASE WHEN f0 IS NULL THEN f1 - f WHEN f1 IS NULL THEN f - f0 ELSE (f1 - f0) / 2 END), 6) AS mean_gradient FROM q, (SELECT 1 FROM series LIMIT 1) GROUP BY record_id""")
def gradient_mean(spark, sf_dir):
    out = series.gradient(waves(spark, sf_dir), "x", F.col("ts_ns").cast("double"))
    return rounded(out.groupBy("record_id").agg(F.avg("slope").alias("mean_gradient")), "mean_gradient")


@query("""b AS (SELECT record_id, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS g FROM series WHERE ok = 0),
c AS (SELECT record_id, count(DISTINCT g) AS c FROM b GROUP BY record_id)
SELECT record_id, round(coalesce(any_value(c), 0) / (count(*) / 200.0), 6) AS rate FROM series LEFT JOIN c USING (record_id) GROUP BY record_id""")
def event_rate(spark, sf_dir):
    """Bursts of invalid samples a second."""
    return rounded(quality.event_rate(events(spark, sf_dir), "bad", 200.0), "rate")


@query("""x AS (SELECT 1) SELECT record_id, coalesce(avg((v BETWEEN 0 AND 1)::INT), 0) >= 0.02 AS normalised FROM series GROUP BY record_id""")
def normalised_share(spark, sf_dir):
    return features.is_normalised(events(spark, sf_dir), ["record_id"], "v", 0.02)


@query("""b AS (SELECT record_id, i, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS g FROM series WHERE ok = 0),
r AS (SELECT record_id, min(i) AS a, max(i) AS b FROM b GROUP BY record_id, g)
SELECT record_id, a // 10 AS segment, a % 10 AS first, b % 10 AS last FROM r WHERE a // 10 = b // 10""")
def segment_containment(spark, sf_dir):
    """Invalid runs that lie in one segment, from its start."""
    runs = series.islands(events(spark, sf_dir), "bad", drop_last=False)
    return series.containment(runs, 10, "first", "last").select("record_id", "segment", "first", "last")


@query("""f AS (SELECT (ts_ns // 3600000000000) % 100 AS frame, avg(v) AS v FROM series GROUP BY 1)
SELECT r.frame, round(f.v, 6) AS v FROM (SELECT unnest(range(120)) AS frame) r LEFT JOIN f USING (frame) WHERE r.frame < 50""")
def frame_budget(spark, sf_dir):
    """The first fifty frames: the limit is the operator."""
    own = events(spark, sf_dir).withColumn("frame", F.expr("ts_ns div 3600000000000") % 100)
    return rounded(series.frame_means(own, "frame", ["v"], 120).orderBy("frame").limit(50), "v")


@query("""a AS (SELECT DISTINCT record_id, ts_ns // 86400000000000 AS day FROM series WHERE event_type = 'click'), b AS (SELECT DISTINCT record_id, ts_ns // 86400000000000 AS day FROM series WHERE event_type = 'view'),
k AS (SELECT coalesce(a.record_id, b.record_id) AS record_id, a.day AS l, b.day AS r FROM a FULL JOIN b ON a.record_id = b.record_id AND a.day = b.day)
SELECT record_id, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (r IS NULL OR l IS NULL) = 0 AS equal FROM k GROUP BY record_id""")
def key_set_equality(spark, sf_dir):
    """Days on which only one of two annotators was there."""
    own = events(spark, sf_dir).withColumn("day", F.expr("ts_ns div 86400000000000"))
    return quality.keys_equal(own.where("event_type = 'click'"), own.where("event_type = 'view'"), "day", "record_id")


@query("""x AS (SELECT 1) SELECT record_id, i, v FROM series s WHERE NOT EXISTS (SELECT 1 FROM series e WHERE e.record_id = s.record_id AND e.event_type = 'error' AND e.i = s.i)""")
def removed_places(spark, sf_dir):
    """Samples but those at listed places."""
    own = series.row_index(events(spark, sf_dir))
    return quality.without_places(own.select("record_id", "i", "v"), own.where("event_type = 'error'"))


@query("""x AS (SELECT 1) SELECT record_id, max(CASE WHEN event_type = 'click' THEN v END) AS click, coalesce(max(CASE WHEN event_type = 'error' THEN v END), max(CASE WHEN event_type = 'view' THEN v END)) AS second FROM series WHERE event_type IN ('click', 'view', 'error') GROUP BY record_id""")
def merged_maps(spark, sf_dir):
    """Two maps of a record merged, the second one's values winning."""
    own = events(spark, sf_dir)
    top = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("v")))
    each = own.where("event_type IN ('click', 'view', 'error')").groupBy("record_id").agg(top("click").alias("c"), top("view").alias("v"), top("error").alias("e"))
    first = F.create_map(F.lit("click"), "c", F.lit("second"), "v")
    second = F.when(F.col("e").isNotNull(), F.create_map(F.lit("second"), "e")).otherwise(F.create_map().cast("map<string,double>"))
    kept = F.map_filter(first, lambda k, v: ~(F.map_contains_key(second, k)))
    return each.select("record_id", F.map_concat(kept, second).alias("m")).select("record_id", F.col("m")["click"].alias("click"), F.col("m")["second"].alias("second"))


@query("""pk AS (SELECT record_id, i, i // 30 AS segment, ok FROM series WHERE v > 20),
d AS (SELECT record_id, segment, i, (i - lag(i) OVER w) * 1000 / 2.0 AS nn, ok AS ok1, lag(ok) OVER w AS ok0 FROM pk WINDOW w AS (PARTITION BY record_id, segment ORDER BY i)),
n AS (SELECT record_id, segment, i, nn FROM d WHERE nn > 250 AND nn < 2500 AND ok1 <> 0 AND ok0 <> 0),
t AS (SELECT record_id, segment, sum(c) / max(c) AS tri FROM (SELECT record_id, segment, floor(nn / 7.8125) AS b, count(*) AS c FROM n GROUP BY ALL) GROUP BY record_id, segment),
e AS (SELECT *, nn - lag(nn) OVER (PARTITION BY record_id, segment ORDER BY i) AS dd FROM n)
SELECT e.record_id, e.segment, count(*) AS n, round(avg(nn), 6) AS mean_nn, round(stddev_samp(nn), 6) AS sdnn, round(sqrt(avg(dd * dd)), 6) AS rmssd, round(any_value(tri), 6) AS tri_index FROM e JOIN t USING (record_id, segment) GROUP BY e.record_id, e.segment""")
def hrv_segments(spark, sf_dir):
    """Variability by segment, of intervals strictly in range without an invalid end."""
    own = series.row_index(events(spark, sf_dir)).withColumn("status", F.col("ok"))
    nn = quality.nn_intervals(own.where("v > 20"), own, 2.0, 30)
    return rounded(ecg.variability(nn, ["record_id", "segment"], "i"), "mean_nn", "sdnn", "rmssd", "tri_index")


_HEART = "WITH " + BEATS + """,
ra AS (SELECT *, min(x) OVER (PARTITION BY record_id) AS lo, max(x) OVER (PARTITION BY record_id) AS hi FROM strip),
sc AS (SELECT record_id, i, x, (x - lo) / (hi - lo) AS s FROM ra),
df AS (SELECT record_id, i, abs(lead(s) OVER (PARTITION BY record_id ORDER BY i) - s) * 1000 < 60 AS small, (s - 0.5) * (lag(s) OVER (PARTITION BY record_id ORDER BY i) - 0.5) < 0 AS cross_ FROM sc),
fl AS (SELECT record_id, max(share) AS flat_share FROM (SELECT record_id, i, sum(small::INT) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 2 PRECEDING) / 20.0 AS share FROM df) WHERE i >= 20 AND (i - 20) % 5 = 0 GROUP BY record_id),
cr AS (SELECT record_id, coalesce(sum(cross_::INT), 0)::BIGINT AS crossings FROM df GROUP BY record_id),
pk AS (SELECT record_id, i FROM beat WHERE i > 0),
be AS (SELECT record_id, avg(d) AS mean, median(d) AS med FROM (SELECT record_id, i - lag(i) OVER (PARTITION BY record_id ORDER BY i) AS d FROM pk) GROUP BY record_id),
am AS (SELECT record_id, max(x) AS amplitude FROM pk JOIN strip USING (record_id, i) GROUP BY record_id),
ha AS (SELECT record_id, 60 * 40.0 / mean AS heart_rate, round_even(least(mean, med) / 2, 0)::INT AS half FROM be),
pa AS (SELECT p.record_id, p.i AS beat, w.i - p.i AS o, w.x, ha.half, count(*) OVER (PARTITION BY p.record_id, p.i) AS n FROM pk p JOIN ha USING (record_id) JOIN strip w ON w.record_id = p.record_id AND w.i BETWEEN p.i - half AND p.i + half WHERE half > 0),
fu AS (SELECT * FROM pa WHERE n = 2 * half + 1),
co AS (SELECT a.record_id, a.beat, b.beat AS other, corr(a.x, b.x) AS r FROM fu a JOIN fu b ON a.record_id = b.record_id AND a.o = b.o GROUP BY ALL),
sr AS (SELECT record_id, avg(r) AS i_score FROM co GROUP BY record_id),
al AS (SELECT DISTINCT record_id FROM strip)
SELECT record_id, round(flat_share, 6) AS flat_share, crossings, round(heart_rate, 6) AS heart_rate, round(amplitude, 6) AS amplitude, round(i_score, 6) AS i_score,
  coalesce((coalesce(flat_share, 0) <= 0.8 AND crossings <= 330 AND heart_rate BETWEEN 24 AND 240 AND amplitude <= 0.45 AND i_score >= 0.15), false)::INT AS acceptable
FROM al LEFT JOIN fl USING (record_id) LEFT JOIN cr USING (record_id) LEFT JOIN ha USING (record_id) LEFT JOIN am USING (record_id) LEFT JOIN sr USING (record_id)"""


@query(_HEART)
def heart_quality(spark, sf_dir):
    """The quality decision on each strip with its figures, from the R peaks found in it."""
    own = strips(spark, sf_dir)
    peaks = ecg.r_peaks(own, "x", 40).where("i > 0")
    out = quality.heart_quality(own, peaks, "x", 40.0, width=20, hop=5, flat_step=60, most_crossings=330, most_amplitude=0.45, least_score=0.15)
    return rounded(out, "flat_share", "heart_rate", "amplitude", "i_score")


@query("""ed AS (SELECT record_id, ts_ns, v, lead(ts_ns) OVER (PARTITION BY record_id ORDER BY ts_ns) IS NULL AS final FROM series WHERE event_type <> 'error'),
te AS (SELECT record_id, ts_ns, 20 + v / 5 AS t FROM series WHERE event_type = 'error'),
la AS (SELECT record_id, arg_max(t, ts_ns) AS t FROM te GROUP BY record_id),
jo AS (SELECT e.record_id, e.ts_ns, e.v, CASE WHEN final THEN la.t ELSE coalesce(te.t, la.t) END AS t FROM ed e ASOF LEFT JOIN te ON e.record_id = te.record_id AND e.ts_ns < te.ts_ns LEFT JOIN la ON e.record_id = la.record_id),
gr AS (SELECT *, v AS f, lag(v) OVER w AS f0, lead(v) OVER w AS f1, ts_ns / 3.6e12 - lag(ts_ns / 3.6e12) OVER w AS hs, lead(ts_ns / 3.6e12) OVER w - ts_ns / 3.6e12 AS hd FROM jo WINDOW w AS (PARTITION BY record_id ORDER BY ts_ns)),
sl AS (SELECT *, CASE WHEN f0 IS NULL THEN (f1 - f) / hd WHEN f1 IS NULL THEN (f - f0) / hs ELSE (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hs + hd)) END AS slope FROM gr),
ba AS (SELECT *, CASE WHEN coalesce(v BETWEEN 0.02 AND 60 AND abs(coalesce(slope, 0)) <= 10 AND t BETWEEN 25 AND 40, false) THEN 0 ELSE 1 END AS bad FROM sl)
SELECT record_id, ts_ns, round(slope, 3) AS slope, round(t, 6) AS temperature, 1 - max(bad) OVER (PARTITION BY record_id ORDER BY ts_ns ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS status FROM ba""")
def skin_quality(spark, sf_dir):
    """Status of skin conductance from its range, its slope and the next temperature, widened by a row."""
    own = events(spark, sf_dir)
    eda = own.where("event_type <> 'error'").select("record_id", "ts_ns", F.col("v").alias("eda"))
    temperature = own.where("event_type = 'error'").select("record_id", "ts_ns", (20 + F.col("v") / 5).alias("temperature"))
    out = quality.skin_quality(eda, temperature, reach=1, step=float(HOUR)).drop("eda")
    return rounded(rounded(out, "slope", digits=3), "temperature")


_EYES = _POINTS + """, st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY record_id ORDER BY i)),
lb AS (SELECT *, (coalesce(step, 0) <= 18)::INT AS label FROM st),
ac AS (SELECT *, step * 50 AS speed, abs(step * 50 - lag(step * 50) OVER w) * 50 AS acc, (label <> coalesce(lag(label) OVER w, -1))::INT AS new FROM lb WINDOW w AS (PARTITION BY record_id ORDER BY i)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY i) AS run FROM ac),
pl AS (SELECT *, row_number() OVER (PARTITION BY record_id, run ORDER BY i) AS k FROM rn)"""


def _labelled(spark, sf_dir):
    """Points with label 1 after a short step."""
    own = gaze.steps(points(spark, sf_dir), 50.0)
    return own.select("record_id", "i", "x", "y", (F.coalesce("step", F.lit(0.0)) <= 18).cast("int").alias("label"))


@query(_EYES + """ SELECT record_id, min(i) AS first, round(count(*) / 50.0, 6) AS duration, round(avg(speed) FILTER (k > 1), 4) AS mean_velocity,
  round(sqrt((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2), 4) AS drift_displacement, round(coalesce(sum(step) FILTER (k > 1), 0), 4) AS drift_distance,
  round(sqrt((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2) / (count(*) / 50.0), 4) AS drift_velocity,
  round(2 * -ln(1 - 0.68) * 3.141592653589793 * stddev_pop(x) * stddev_pop(y) * sqrt(greatest(1 - CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN coalesce(corr(x, y), 0) ELSE 0 END ** 2, 0)), 2) AS bcea
FROM pl, one WHERE label = 1 GROUP BY record_id, run""")
def fixation_features(spark, sf_dir):
    out = gaze.fixation_features(_labelled(spark, sf_dir), "label", 50.0)
    return rounded(rounded(rounded(out, "duration"), "bcea", digits=2), "mean_velocity", "drift_displacement", "drift_distance", "drift_velocity", digits=4)


@query(_EYES + """, sa AS (SELECT record_id, min(i) AS first, count(*) / 50.0 AS duration, sqrt((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2) AS amplitude,
  sum(step) FILTER (k > 1) AS way, max(speed) FILTER (k > 1) AS pv, max(acc) FILTER (k > 2) AS pa FROM pl WHERE label = 0 GROUP BY record_id, run)
SELECT record_id, first, round(duration, 6) AS duration, round(amplitude, 4) AS amplitude, round(pv, 4) AS peak_velocity, round(pa, 3) AS peak_acceleration, round(CASE WHEN way > 0 THEN amplitude / way END, 5) AS efficiency, round(CASE WHEN amplitude > 0 THEN pv / amplitude END, 5) AS ratio FROM sa, one""")
def saccade_features(spark, sf_dir):
    out = gaze.saccade_features(_labelled(spark, sf_dir), "label", 50.0)
    out = rounded(rounded(rounded(out, "duration"), "amplitude", "peak_velocity", digits=4), "peak_acceleration", digits=3)
    return rounded(out, "efficiency", "ratio", digits=5)


@query(_EYES + """, cd AS (SELECT record_id, run, i, x, y, first_value(x) OVER f AS ax, first_value(y) OVER f AS ay, last_value(x) OVER f AS bx, last_value(y) OVER f AS by_, lag(x) OVER o AS lx, lag(y) OVER o AS ly
  FROM pl WHERE label = 0 WINDOW f AS (PARTITION BY record_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o AS (PARTITION BY record_id, run ORDER BY i)),
sg AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS chord, sqrt((x - lx) ** 2 + (y - ly) ** 2) AS v, i - 0.5 AS m FROM cd),
di AS (SELECT *, CASE WHEN chord > 0 THEN ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / chord END AS d, (lx - ax) * (y - ay) - (x - ax) * (ly - ay) AS tw, sum(v * m) OVER q / nullif(sum(v) OVER q, 0) AS mean FROM sg WINDOW q AS (PARTITION BY record_id, run)),
ag AS (SELECT record_id, run, min(i) AS first, max(chord) AS chord, max(bx - ax) AS cx, max(by_ - ay) AS cy, arg_max(d, (abs(d), -i)) AS d, abs(sum(tw) / 2) AS area,
  sum(v * (m - mean) ** 2) / nullif(sum(v), 0) AS two, sum(v * (m - mean) ** 3) / nullif(sum(v), 0) AS three FROM di GROUP BY record_id, run),
pr AS (SELECT *, (cx * lag(cx) OVER w + cy * lag(cy) OVER w) / nullif(chord * lag(chord) OVER w, 0) AS cs FROM ag WINDOW w AS (PARTITION BY record_id ORDER BY run))
SELECT record_id, first, round(CASE WHEN chord > 0 THEN d / chord END, 5) AS deviation, round(CASE WHEN chord > 0 THEN area END, 3) AS curvature_area, round(CASE WHEN cs IS NOT NULL THEN degrees(acos(greatest(least(cs, 1), -1))) END, 4) AS successive_deviation,
  round(CASE WHEN two > 1e-12 THEN three / two ** 1.5 END, 5) AS skewness_exponent FROM pr, one""")
def saccade_shape(spark, sf_dir):
    """How saccades bend, turn from one to the next, and speed up."""
    out = gaze.saccade_shape(_labelled(spark, sf_dir), "label")
    return rounded(rounded(rounded(out, "deviation", "skewness_exponent", digits=5), "curvature_area", digits=3), "successive_deviation", digits=4)


@query(_EYES + " SELECT record_id, round(count(DISTINCT run) FILTER (label = 0) / (count(*) / 50.0), 6) AS frequency FROM pl, one GROUP BY record_id")
def saccade_rate(spark, sf_dir):
    return rounded(gaze.saccade_rate(_labelled(spark, sf_dir), "label", 50.0), "frequency")


@query(_POINTS + """, ar AS (SELECT *, (x > 0)::INT * 2 + (y > 0)::INT AS area FROM p),
e AS (SELECT record_id, area, count(*) AS n, 2 * -ln(1 - 0.68) * 3.141592653589793 * stddev_pop(x) * stddev_pop(y) * sqrt(greatest(1 - CASE WHEN count(*) > 1 THEN coalesce(corr(x, y), 0) ELSE 0 END ** 2, 0)) AS b FROM ar GROUP BY record_id, area)
SELECT record_id, count(*) AS areas, round(avg(b) FILTER (n >= 3), 3) AS bcea_mean, round(stddev_pop(b) FILTER (n >= 3), 3) AS bcea_dispersion FROM e, one GROUP BY record_id""")
def area_dispersion(spark, sf_dir):
    area = ((F.col("x") > 0).cast("int") * 2 + (F.col("y") > 0).cast("int")).alias("area")
    return rounded(gaze.area_dispersion(points(spark, sf_dir).select("*", area), "area"), "bcea_mean", "bcea_dispersion", digits=3)


_WORDS = """cu AS (SELECT event_type, list(c ORDER BY c) AS cuts FROM (SELECT event_type, unnest(quantile_cont(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS c FROM series GROUP BY event_type) GROUP BY event_type),
wo AS (SELECT event_type, record_id, string_agg(chr((97 + len(list_filter(cuts, lambda c: c < v)))::INT), '' ORDER BY ts_ns, chr((97 + len(list_filter(cuts, lambda c: c < v)))::INT)) AS word FROM series JOIN cu USING (event_type) GROUP BY event_type, record_id)"""


@query(_WORDS + " SELECT event_type, record_id, word FROM wo")
def symbol_words(spark, sf_dir):
    """Each record's values as letters of their quantile bins, by family."""
    return gaze.symbols(events(spark, sf_dir), "event_type", "v", "ts_ns", bins=8)


@query(_WORDS + """, cl AS (SELECT event_type || ':' || record_id::VARCHAR AS record_id, word FROM wo),
hd AS (SELECT record_id AS medoid, word AS m FROM cl ORDER BY md5(record_id || ':1'), record_id LIMIT 8),
al AS (SELECT cl.record_id, medoid, levenshtein(word, m) / greatest(length(word), length(m), 1) AS d FROM cl, hd)
SELECT record_id, arg_min(medoid, (d, medoid)) AS medoid, round(min(d), 6) AS distance FROM al GROUP BY record_id""")
def word_clusters(spark, sf_dir):
    """The nearest of eight words of each word of all families: their number is the operator's."""
    return rounded(gaze.word_clusters(_words(spark, sf_dir), 8, rounds=0), "distance")


def _words(spark, sf_dir):
    """The words of all families, named by family and record."""
    words = gaze.symbols(events(spark, sf_dir), "event_type", "v", "ts_ns", bins=8)
    return words.select(F.concat_ws(":", "event_type", F.col("record_id").cast("string")).alias("record_id"), "word")


@query()
def word_medoids(spark, sf_dir):
    """Clusters of those words around eight medoids that move until nothing changes."""
    return rounded(gaze.word_clusters(_words(spark, sf_dir), 8), "distance")


_LONG = """fe AS (SELECT record_id, i // 10 AS segment, avg(v) AS mean, CASE WHEN count(*) FILTER (ok = 1) > 2 THEN avg(v) FILTER (ok = 1) END AS valid_mean FROM series WHERE (i // 10 + 1) * 10 <= n GROUP BY record_id, i // 10)"""


def _segment_features(spark, sf_dir):
    cut = series.tiles(events(spark, sf_dir), 10)
    good = F.when(F.col("ok") == 1, F.col("v"))
    return cut, cut.groupBy("record_id", "segment").agg(F.avg("v").alias("mean"), F.when(F.count(good) > 2, F.avg(good)).alias("valid_mean"))


@query(_LONG + """ SELECT record_id, segment, 'skin' AS family, metric, round(value, 6) AS value FROM (SELECT record_id, segment, 'mean' AS metric, mean AS value FROM fe UNION ALL SELECT record_id, segment, 'valid_mean', valid_mean FROM fe) WHERE value IS NOT NULL""")
def feature_table(spark, sf_dir):
    """Features of all records as one long table."""
    return rounded(quality.long_features(_segment_features(spark, sf_dir)[1], ["record_id", "segment"], "skin"), "value")


@query(_LONG + """ SELECT record_id, segment, round(valid_mean, 6) AS valid_mean FROM fe""")
def segment_spine(spark, sf_dir):
    """A row for each segment, null where its feature failed."""
    cut, own = _segment_features(spark, sf_dir)
    return rounded(quality.on_spine(cut, own.where("valid_mean IS NOT NULL").drop("mean"), ["record_id", "segment"]), "valid_mean")


@query(_LONG + """ SELECT record_id, count(*) AS n, round(sum(mean), 4) AS total FROM fe GROUP BY record_id""")
def feature_csv(spark, sf_dir):
    """Features written as CSV by record and read again."""
    at = f"{shared_dir(spark)}/tidegrid-csv-{uuid.uuid4().hex}"
    sensors.write_features(_segment_features(spark, sf_dir)[1], at, "skin")
    out = spark.read.schema("record_id LONG, segment LONG, mean DOUBLE, valid_mean DOUBLE").csv(f"{at}/skin", header=True)
    return out.groupBy("record_id").agg(F.count("*").alias("n"), F.round(F.sum("mean"), 4).alias("total"))


@query(_PAIRS + """, me AS (SELECT win, beat, avg(r) AS g, list(r ORDER BY other) AS rs FROM r GROUP BY win, beat),
wi AS (SELECT win, avg(g) AS g, arg_max(beat, (g, -beat)) AS main, list(beat ORDER BY beat) AS bs FROM me GROUP BY win),
ma AS (SELECT w.win, w.g, w.main, w.bs, m.rs, CASE WHEN w.g BETWEEN 0.05 AND 0.9 THEN list_filter(w.bs, lambda b, k: m.rs[k] < 0.05) ELSE [] END AS suspects, list_filter(w.bs, lambda b, k: m.rs[k] >= 0.05) AS good FROM wi w JOIN me m ON m.win = w.win AND m.beat = w.main),
cl AS (WITH RECURSIVE t AS (
  SELECT win, suspects AS rest, bs, 0 AS n_groups, 0 AS n_noise, 0::DOUBLE AS total FROM ma
  UNION ALL
  SELECT win, list_filter(rest, lambda b: NOT list_contains(near, b)), bs, n_groups + (len(near) > 1)::INT, n_noise + (len(near) = 1)::INT,
    total + CASE WHEN len(near) = 1 THEN 1.6 * exp(-0.4 * (n_noise + 1)) - 0.01 ELSE (list_sum(list_transform(near, lambda b: rs[list_position(bs, b)])) - 1) / (len(near) - 1) * (1.7 * exp(-0.5 * (n_groups + 1)) - 0.005) END
  FROM (SELECT t.*, m.rs, list_filter(rest, lambda b: b = rest[1] OR m.rs[list_position(bs, b)] > 0.9051) AS near FROM t JOIN me m ON m.win = t.win AND m.beat = t.rest[1] WHERE len(rest) > 0))
  SELECT * FROM t WHERE len(rest) = 0),
gd AS (SELECT m.win, avg(e.r) AS good FROM ma m JOIN r e ON e.win = m.win AND list_contains(m.good, e.beat) AND list_contains(m.good, e.other) GROUP BY m.win)
SELECT m.win, len(m.suspects)::BIGINT AS n_suspects, c.n_groups::BIGINT AS n_groups, c.n_noise::BIGINT AS n_noise, round(CASE WHEN len(m.suspects) > 0 THEN (c.total / (c.n_groups + c.n_noise) + g.good) / 2 END, 6) AS a_score
FROM ma m JOIN cl c USING (win) LEFT JOIN gd g USING (win)""")
def beat_clusters(spark, sf_dir):
    """Suspect beats of each window by groups, and the score from them."""
    return rounded(quality.beat_clusters(_correlations(spark, sf_dir), "win", "beat", low=0.05), "a_score")


@query("""WITH po AS (SELECT o_custkey AS record, o_orderkey AS frame, o_custkey % 700 AS mx, o_orderkey % 500 AS my, o_custkey % 700 + o_orderkey % 7 AS ax, o_orderkey % 500 + o_custkey % 5 AS ay, o_custkey % 700 - o_orderkey % 11 AS bx, o_orderkey % 500 - o_custkey % 90 AS by_ FROM orders),
ok AS (SELECT record, bool_and((frame % 37 <> 5) = (frame % 41 <> 3)) AS same FROM po GROUP BY record),
di AS (SELECT record, frame, frame % 37 <> 5 AS in_a, frame % 41 <> 3 AS in_b, same, sqrt((ax - mx) ** 2 + (ay - my) ** 2) AS da, sqrt((bx - mx) ** 2 + (by_ - my) ** 2) AS db FROM po JOIN ok USING (record) WHERE mx > 0 AND mx < 600 AND my > 0 AND my < 450)
SELECT record, frame, same AS both, round(CASE WHEN same THEN (da + db) / 2 ELSE db END / 750, 6) AS distance FROM di WHERE in_b AND CASE WHEN same THEN (da + db) / 2 ELSE db END / 750 < 0.06""")
def annotator_fallback(spark, sf_dir):
    """Distances of two annotators' points, of one of them alone in records where they did not see the same frames."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = [c.alias("record"), k.alias("frame"), (c % 700).alias("mx"), (k % 500).alias("my")]
    a = o.where("o_orderkey % 37 <> 5").select(*base, (c % 700 + k % 7).alias("x"), (k % 500 + c % 5).alias("y"))
    b = o.where("o_orderkey % 41 <> 3").select(*base, (c % 700 - k % 11).alias("x"), (k % 500 - c % 90).alias("y"))
    return rounded(features.annotation_distances(a, b), "distance")


_STATUS = """x AS (SELECT 1), qu AS (SELECT record_id, count(*) AS n, avg(ok) AS valid, min(CASE WHEN ok = 0 THEN i END) AS first_bad FROM series GROUP BY record_id)"""


@query(_STATUS + """ SELECT record_id, n, round(valid, 6) AS valid, first_bad, CASE WHEN valid >= 0.5 THEN 1 ELSE 0 END AS usable FROM qu""")
def quality_bundle(spark, sf_dir):
    """Quality of records written as a typed bundle and read again."""
    own = series.row_index(events(spark, sf_dir))
    told = own.groupBy("record_id").agg(F.count("*").alias("n"), F.avg("ok").alias("valid"), F.min(F.when(F.col("ok") == 0, F.col("i"))).alias("first_bad"))
    told = told.withColumn("usable", (F.col("valid") >= 0.5).cast("int"))
    root = f"{shared_dir(spark)}/tidegrid-quality-{uuid.uuid4().hex}"
    bundles.write(told, root, "quality")
    return rounded(bundles.read(spark, root, "quality"), "valid")


@query(_LONG + """ SELECT family, metric, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'skin' AS family, 'mean' AS metric, mean AS value FROM fe UNION ALL SELECT 'skin', 'valid_mean', valid_mean FROM fe) WHERE value IS NOT NULL GROUP BY family, metric""")
def features_bundle(spark, sf_dir):
    """Features of segments written as a typed bundle, by family, and summed up from it."""
    told = quality.long_features(_segment_features(spark, sf_dir)[1], ["record_id", "segment"], "skin")
    root = f"{shared_dir(spark)}/tidegrid-features-{uuid.uuid4().hex}"
    bundles.write(told, root, "features")
    return rounded(bundles.read(spark, root, "features").groupBy("family", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("""x AS (SELECT 1), g AS (SELECT record_id, unnest(range(a, a + ((b - a) // 21600000000000) * 21600000000000 + 1, 21600000000000)) AS ts_ns FROM (SELECT record_id, min(ts_ns) AS a, max(ts_ns) AS b FROM series GROUP BY record_id)),
nx AS (SELECT g.record_id, g.ts_ns, s.seq FROM g ASOF LEFT JOIN series s ON g.record_id = s.record_id AND g.ts_ns <= s.ts_ns),
tw AS (SELECT record_id, seq FROM series WHERE i = 1), fi AS (SELECT record_id, min(ts_ns) AS a FROM series GROUP BY record_id)
SELECT nx.record_id, nx.ts_ns, CASE WHEN nx.ts_ns = fi.a THEN coalesce(tw.seq, nx.seq) ELSE nx.seq END AS seq FROM nx JOIN fi USING (record_id) LEFT JOIN tw USING (record_id)""")
def resample_discrete(spark, sf_dir):
    """A discrete column on the grid: the next sample's value."""
    return series.resample(events(spark, sf_dir), [], 6 * HOUR, discrete=["seq"])

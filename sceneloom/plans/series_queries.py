"""Time-series operators over event poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions.columns import r6
from sceneloom.operators import series
from sceneloom.plans.adapters import STATES, states
from sceneloom.plans.registry import query

KEYS = ["clip", "instance"]


@query(f"""WITH {STATES}, s AS (SELECT *, t - min(t) OVER (PARTITION BY clip) AS since FROM states),
b AS (SELECT clip, instance, event_id, since, floor(since * 0.0005::DOUBLE + 0.5)::BIGINT AS bucket FROM s)
SELECT clip, bucket, round(max_by(since, event_id), 6) AS t, max(event_id) AS event_id FROM b WHERE bucket BETWEEN 0 AND 499 GROUP BY clip, bucket""")
def t1_sample_frames(spark, d):
    from pyspark.sql import Window

    rows = states(spark, d).withColumn("__t0", F.min("t").over(Window.partitionBy("clip")))
    out = series.sample_frames(rows, 0.0005, F.col("__t0"), 1_000_000.0, ["clip"])
    return out.select("clip", "bucket", r6(F.col("t")).alias("t"), "event_id")


@query(f"""WITH {STATES}, r AS (SELECT clip, instance, event_id, row_number() OVER (PARTITION BY clip ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM states)
SELECT clip, instance, event_id FROM r WHERE n <= 12 OR list_contains(list_transform(range(12), lambda j: round_even(j * (n - 1) / 11::DOUBLE, 0)::BIGINT), i)""")
def t2_pick_uniform(spark, d):
    return series.pick_uniform(states(spark, d), 12, ["clip"], ["t", "event_id"]).select("clip", "instance", "event_id")


@query(f"""WITH {STATES}, m AS (SELECT *, coalesce(abs(x - lag(x) OVER w), 0) AS motion FROM states WINDOW w AS (PARTITION BY clip ORDER BY t, event_id)),
q AS (SELECT *, motion + 0.25::DOUBLE * avg(motion) OVER (PARTITION BY clip) + 1e-6::DOUBLE AS wt, row_number() OVER (PARTITION BY clip ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY clip) AS n FROM m),
s AS (SELECT *, sum(wt) OVER (PARTITION BY clip ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) / sum(wt) OVER (PARTITION BY clip) AS share FROM q),
b AS (SELECT *, coalesce(lag(share) OVER (PARTITION BY clip ORDER BY t, event_id), -1) AS before FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t, event_id) AS r FROM b
  WHERE i = 1 OR i = n OR len(list_filter(list_transform(range(8), lambda j: j / 7::DOUBLE), lambda x: x > before AND x <= share)) > 0)
SELECT clip, event_id FROM k WHERE r <= 8""")
def t3_select_keyframes(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("clip").orderBy("t", "event_id")
    rows = states(spark, d).withColumn("motion", F.coalesce(F.abs(F.col("x") - F.lag("x").over(o)), F.lit(0.0)))
    return series.select_keyframes(rows, 8, ["clip"], ["t", "event_id"], "motion").select("clip", "event_id")


@query(f"""WITH {STATES}, s AS (SELECT *, t - lag(t) OVER (PARTITION BY clip, instance ORDER BY t) <= 0 AS still FROM states)
SELECT clip, instance, count(*) AS samples, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end,
  CASE WHEN bool_or(coalesce(still, false)) THEN 'repeated_time' WHEN bool_or(x IS NULL OR y IS NULL) THEN 'non_finite_position' END AS reason FROM s GROUP BY clip, instance""")
def t4_build_tracks(spark, d):
    out = series.build_tracks(states(spark, d), KEYS)
    return out.withColumn("t_start", r6(F.col("t_start"))).withColumn("t_end", r6(F.col("t_end")))


@query(f"""WITH {STATES}, span AS (SELECT clip, min(t) AS t0, max(t) AS t1 FROM states GROUP BY clip), keys AS (SELECT DISTINCT clip, instance FROM states),
q AS (SELECT k.clip, k.instance, j, t0 + (t1 - t0) * j / 20::DOUBLE AS t FROM keys k JOIN span USING (clip), (SELECT unnest(range(21)) AS j) g),
a AS (SELECT q.clip, q.instance, q.j, q.t, max_by(struct_pack(t := s.t, x := s.x, y := s.y), s.t) AS a FROM q JOIN states s ON s.clip = q.clip AND s.instance = q.instance AND s.t <= q.t GROUP BY ALL),
b AS (SELECT q.clip, q.instance, q.j, min_by(struct_pack(t := s.t, x := s.x, y := s.y), s.t) AS b FROM q JOIN states s ON s.clip = q.clip AND s.instance = q.instance AND s.t >= q.t GROUP BY ALL)
SELECT q.clip, q.instance, q.j::INTEGER AS j, CASE WHEN b.b IS NULL OR a.a IS NULL THEN NULL WHEN b.b.t > a.a.t THEN round(a.a.x + (b.b.x - a.a.x) * (q.t - a.a.t) / (b.b.t - a.a.t), 4) ELSE round(a.a.x, 4) END AS x
FROM q LEFT JOIN a ON a.clip = q.clip AND a.instance = q.instance AND a.j = q.j LEFT JOIN b ON b.clip = q.clip AND b.instance = q.instance AND b.j = q.j""")
def t5_resample_linear(spark, d):
    s = states(spark, d)
    span = s.groupBy("clip").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    asks = s.select("clip", "instance").distinct().join(span, "clip").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(20))))
    asks = asks.withColumn("t", F.expr("t0 + (t1 - t0) * j / 20D"))
    out = series.resample_linear(s, asks, KEYS, values=("x",))
    return asks.join(out, [*KEYS, "t"]).select(*KEYS, "j", (F.round("x", 4) + F.lit(0.0)).alias("x"))


@query(f"""WITH {STATES}, span AS (SELECT clip, instance, min(t) AS a0, max(t) AS a1 FROM states GROUP BY clip, instance),
w AS (SELECT *, min(a0) OVER (PARTITION BY clip) AS t0, max(a1) OVER (PARTITION BY clip) AS t1 FROM span),
p AS (SELECT a.clip, a.instance AS gt, b.instance AS pred, a.t0, a.t1, greatest(least(a.t1, a.a1, b.a1) - greatest(a.t0, a.a0, b.a0), 0) / (a.t1 - a.t0) AS c FROM w a JOIN w b ON a.clip = b.clip AND a.instance < b.instance WHERE a.t1 > a.t0)
SELECT clip, gt, pred, round(c, 6) AS coverage, CASE WHEN c <= 0 THEN 'unavailable' WHEN c >= 0.9 THEN 'complete' ELSE 'partial' END AS status FROM p""")
def t6_coverage_window(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("clip")
    span = states(spark, d).groupBy("clip", "instance").agg(F.min("t").alias("a0"), F.max("t").alias("a1"))
    span = span.withColumn("t0", F.min("a0").over(by)).withColumn("t1", F.max("a1").over(by))
    other = span.select("clip", F.col("instance").alias("pred"), F.col("a0").alias("b0"), F.col("a1").alias("b1"))
    pairs = span.withColumnRenamed("instance", "gt").join(other, "clip").where("gt < pred and t1 > t0")
    return series.coverage_window(pairs, "t0", "t1", "a0", "a1", "b0", "b1").select("clip", "gt", "pred", r6(F.col("coverage")).alias("coverage"), "status")


@query(f"""WITH {STATES}, c AS (SELECT *, min(t) OVER (PARTITION BY clip) + (max(t) OVER (PARTITION BY clip) - min(t) OVER (PARTITION BY clip)) * (1 - 0.2::DOUBLE) AS cut FROM states)
SELECT clip, CASE WHEN t <= cut THEN 'fit' ELSE 'holdout' END AS "window", count(*) AS n, round(avg(x), 6) AS mean_x FROM c GROUP BY ALL""")
def t7_holdout_split(spark, d):
    return series.holdout_cut(states(spark, d), ["clip"]).groupBy("clip", "window").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean_x"))


@query(f"""WITH {STATES}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY clip, instance) AS n FROM states WINDOW w AS (PARTITION BY clip, instance ORDER BY t, event_id)),
k AS (SELECT clip, instance, list(x ORDER BY i) AS xs FROM r GROUP BY ALL), h AS (SELECT *, least(5, CASE WHEN len(xs) % 2 = 1 THEN len(xs) ELSE len(xs) - 1 END) // 2 AS h FROM k)
SELECT r.clip, r.instance, r.event_id, round(CASE WHEN h <= 0 THEN r.x ELSE list_sum(list_transform(range(-h, h + 1), lambda o: xs[greatest(1, least(n, i + o))])) / (2 * h + 1) END, 6) AS smooth
FROM r JOIN h USING (clip, instance)""")
def t8_moving_average(spark, d):
    out = series.moving_average(states(spark, d), KEYS, ["t", "event_id"], "x", 5)
    return out.select(*KEYS, "event_id", r6(F.col("smooth")).alias("smooth"))


@query(f"""WITH {STATES}, r AS (SELECT *, y - lag(y) OVER (PARTITION BY clip, instance ORDER BY t, event_id) AS d FROM states),
s AS (SELECT *, coalesce(d - 90 * floor(d / 90 + 0.5::DOUBLE), y) AS step FROM r)
SELECT clip, instance, event_id, round(sum(step) OVER (PARTITION BY clip, instance ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM s""")
def t9_unwrap_yaw(spark, d):
    out = series.unwrap_angle(states(spark, d), KEYS, ["t", "event_id"], "y", 90.0)
    return out.select(*KEYS, "event_id", r6(F.col("unwrapped")).alias("unwrapped"))


@query(f"""WITH {STATES}, a AS (SELECT clip, t, event_id FROM states WHERE instance = 'click'), b AS (SELECT clip, t, y FROM states WHERE instance = 'view'),
j AS (SELECT a.clip, a.t, a.event_id, b.t AS bt, b.y, abs(b.t - a.t) AS gap FROM a LEFT JOIN b ON a.clip = b.clip AND abs(b.t - a.t) <= 50000),
m AS (SELECT clip, t, event_id, bt, y, gap FROM j QUALIFY row_number() OVER (PARTITION BY clip, t, event_id ORDER BY gap NULLS LAST, bt) = 1)
SELECT clip, round(t, 6) AS t, round(bt, 6) AS match_t, y, round(gap, 4) AS gap FROM m""")
def t10_nearest_time_join(spark, d):
    s = states(spark, d)
    out = series.nearest_time_join(s.where("instance = 'click'"), s.where("instance = 'view'"), ["clip"], "y", 50_000.0)
    return out.select("clip", r6(F.col("t")).alias("t"), r6(F.col("match_t")).alias("match_t"), "y", (F.round("gap", 4) + F.lit(0.0)).alias("gap"))


HOURS = f"WITH {STATES}, f AS (SELECT clip, instance, floor(t / 3600)::BIGINT AS frame FROM states)"


def _framed(spark, d):
    return states(spark, d).withColumn("frame", F.floor(F.col("t") / 3600).cast("long"))


@query(HOURS + """, s AS (SELECT clip, instance, count(DISTINCT frame) AS frames FROM f GROUP BY ALL), c AS (SELECT clip, count(DISTINCT frame) AS registered FROM f GROUP BY ALL),
k AS (SELECT *, frames / registered AS fraction, row_number() OVER (PARTITION BY clip ORDER BY frames DESC, instance) AS r FROM s JOIN c USING (clip))
SELECT clip, instance, frames, registered, round(fraction, 6) AS fraction, fraction >= 0.3 OR r <= 1 AS kept FROM k""")
def t12_track_filter(spark, d):
    out = series.track_filter(_framed(spark, d), ["clip"], "instance", "frame", 0.3, 1)
    return out.select("clip", "instance", "frames", "registered", r6(F.col("fraction")).alias("fraction"), "kept")


@query(HOURS + " SELECT clip, instance, count(DISTINCT frame) AS frames, round(count(DISTINCT frame) / (max(frame) - min(frame) + 1), 6) AS contiguity FROM f GROUP BY ALL")
def t13_contiguity(spark, d):
    return series.contiguity(_framed(spark, d), KEYS, "frame").withColumn("contiguity", r6(F.col("contiguity")))


@query("SELECT conv_id, count(DISTINCT turn) AS frames, round(count(DISTINCT turn) / (max(turn) - min(turn) + 1), 6) AS contiguity FROM conversations GROUP BY ALL")
def t13_turn_contiguity(spark, d):
    from sceneloom.plans.adapters import table

    return series.contiguity(table(spark, d, "conversations"), ["conv_id"], "turn").withColumn("contiguity", r6(F.col("contiguity")))


@query(f"""WITH {STATES}, n AS (SELECT *, count(*) OVER (PARTITION BY clip, instance) AS n FROM states), k AS (SELECT * FROM n WHERE n >= 6),
g AS (SELECT *, sign(last(x) OVER whole - first(x) OVER whole) AS dir FROM k WINDOW whole AS (PARTITION BY clip, instance ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, dir * (x - lag(x) OVER o) / (t - lag(t) OVER o) AS v FROM g WINDOW o AS (PARTITION BY clip, instance ORDER BY t)),
m AS (SELECT *, max(abs(v)) OVER (PARTITION BY clip, instance) AS top FROM v WHERE v IS NOT NULL),
f AS (SELECT *, abs(v) > 0.1 * top AS fast FROM m),
b AS (SELECT *, last_value(CASE WHEN fast THEN sign(v) END IGNORE NULLS) OVER (PARTITION BY clip, instance ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT clip, instance, count(*) AS steps, count(*) FILTER (WHERE fast AND sign(v) <> before) AS reversals, round(avg((abs(v) < 0.1 * top)::INT), 6) AS rest_share FROM b GROUP BY ALL""")
def t14_velocity_structure(spark, d):
    return series.velocity_structure(states(spark, d), KEYS, "t", "x").withColumn("rest_share", r6(F.col("rest_share")))


@query(f"""WITH {STATES}, c AS (SELECT clip, instance, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy, count(*) AS samples FROM states GROUP BY ALL)
SELECT clip, instance, samples, round(sqrt(avg((x - cx) ** 2 + (y - cy) ** 2)), 6) AS jitter FROM states JOIN c USING (clip, instance) WHERE samples >= 4 GROUP BY ALL""")
def t15_jitter(spark, d):
    return series.jitter(states(spark, d), KEYS, ("x", "y")).withColumn("jitter", r6(F.col("jitter")))


@query(f"""WITH {STATES}, r AS (SELECT x, floor(5 * (row_number() OVER (PARTITION BY clip, instance ORDER BY t, event_id) - 1) / count(*) OVER (PARTITION BY clip, instance))::INT AS phase FROM states)
SELECT phase, round(avg(x), 6) AS error, count(*) AS n FROM r GROUP BY phase""")
def t15_drift_by_phase(spark, d):
    return series.drift_by_phase(states(spark, d), KEYS, ["t", "event_id"], "x").withColumn("error", r6(F.col("error")))

"""Further rules and report fields of operators that other modules register the core of."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions import columns as C
from sceneloom.functions.columns import GROUND_CLASSES, r6
from sceneloom.operators import evaluation as E
from sceneloom.operators import geometry as G
from sceneloom.operators import matching as M
from sceneloom.operators import retrieval as R
from sceneloom.operators import rules, scene, series
from sceneloom.plans.adapters import NODES, PREDICTIONS, STATES, nodes, predictions, states, table
from sceneloom.plans.registry import query

KEYS = ["clip", "instance"]

SCENE = f"""{NODES}, n AS (SELECT clip, node, grp, class || '-' || node AS node_id, CASE WHEN grp = 'static' AND node % 2 = 0 THEN 'floor' ELSE class END AS class, px, py, pz, ex, ey, ez,
  CASE WHEN node % 13 = 0 THEN 0 ELSE sin(0.2::DOUBLE * (node % 8)) * CASE WHEN node % 11 = 0 THEN 1.01 ELSE 1 END END AS qx, CASE WHEN node % 13 = 0 THEN 0 ELSE cos(0.2::DOUBLE * (node % 8)) * CASE WHEN node % 11 = 0 THEN 1.01 ELSE 1 END END AS qw FROM nodes),
named AS (SELECT *, CASE WHEN node % 3 = 0 THEN lag(node_id) OVER (PARTITION BY clip ORDER BY node) END AS support, sqrt(qx * qx + qw * qw) AS norm FROM n),
b AS (SELECT *, abs(1 - 2 * (qx / norm) * (qx / norm)) AS c, abs(2 * (qx / norm) * (qw / norm)) AS s FROM named WHERE norm > 1e-12),
w AS (SELECT clip, node, node_id, grp, class, support, px - ex / 2 AS lox, px + ex / 2 AS hix, py - (c * ey + s * ez) / 2 AS loy, py + (c * ey + s * ez) / 2 AS hiy, pz - (s * ey + c * ez) / 2 AS loz, pz + (s * ey + c * ez) / 2 AS hiz FROM b)"""


@query(f"""WITH {SCENE}, g AS (SELECT DISTINCT o.clip, o.node FROM w o JOIN w s ON o.clip = s.clip AND o.grp = 'object' AND s.grp = 'static' AND s.class = 'floor' AND o.lox <= s.hix AND o.hix >= s.lox AND o.loz <= s.hiz AND o.hiz >= s.loz AND o.loy < s.hiy - 0.05),
h AS (SELECT CASE WHEN NOT (o.lox <= s.hix AND o.hix >= s.lox AND o.loz <= s.hiz AND o.hiz >= s.loz) THEN 'support_no_overlap' WHEN o.loy - s.hiy < -0.05 THEN 'support_penetration' WHEN o.loy - s.hiy > 0.05 THEN 'support_gap' END AS code FROM w o JOIN w s ON o.clip = s.clip AND o.support = s.node_id WHERE o.grp = 'object')
SELECT code, CASE WHEN code = 'support_gap' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM (SELECT 'zero_quaternion' AS code FROM named WHERE norm <= 1e-12 UNION ALL SELECT 'non_unit_quaternion' FROM named WHERE norm > 1e-12 AND abs(norm - 1) > 1e-3
  UNION ALL SELECT 'ground_penetration' FROM g UNION ALL SELECT code FROM h WHERE code IS NOT NULL) GROUP BY code""")
def v2_scene_geometry(spark, d):
    """Turned boxes: quaternions, ground, and the supports that nodes name."""
    from pyspark.sql import Window

    scaled = F.expr("CASE WHEN node % 13 = 0 THEN 0D WHEN node % 11 = 0 THEN 1.01D ELSE 1D END")
    n = nodes(spark, d).withColumns({
        "node_id": F.concat_ws("-", "class", F.col("node").cast("string")), "class": F.when((F.col("grp") == "static") & (F.col("node") % 2 == 0), "floor").otherwise(F.col("class")),
        "qx": F.expr("sin(0.2D * (node % 8))") * scaled, "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.expr("cos(0.2D * (node % 8))") * scaled})
    n = n.withColumn("support", F.when(F.col("node") % 3 == 0, F.lag("node_id").over(Window.partitionBy("clip").orderBy("node"))))
    return rules.geometry_findings(n, GROUND_CLASSES).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NODES}, k AS (SELECT clip, node, i, (i - CASE WHEN node % 5 = 0 AND i = 2 THEN 2 ELSE 0 END)::DOUBLE AS t FROM nodes, (SELECT unnest(range(4)) AS i)), b AS (SELECT clip, t - lag(t) OVER (PARTITION BY clip, node ORDER BY i) AS step FROM k),
e AS (SELECT clip, node AS event, node::DOUBLE AS t, CASE WHEN node % 4 = 0 THEN 99 ELSE node END AS target, CASE WHEN node % 3 = 0 THEN node + 1 END AS partner FROM nodes),
u AS (SELECT clip, 3 + clip % 3 AS duration FROM (SELECT DISTINCT clip FROM nodes))
SELECT code, severity, count(*) AS n FROM (SELECT 'keyframes_not_rising' AS code, 'error' AS severity FROM b WHERE step <= 0 UNION ALL SELECT 'unknown_event_target', 'error' FROM e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.clip = e.clip AND n.node = e.target)
  UNION ALL SELECT 'unknown_event_partner', 'error' FROM e WHERE partner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.clip = e.clip AND n.node = e.partner) UNION ALL SELECT 'event_after_clip', 'warning' FROM e JOIN u USING (clip) WHERE t > duration) GROUP BY ALL""")
def v1_times_and_events(spark, d):
    """Key frames whose times do not rise, and events without their nodes or after the end."""
    n = nodes(spark, d)
    frames = n.select("clip", "node", F.posexplode(F.expr("transform(sequence(0, 3), i -> cast(i - CASE WHEN node % 5 = 0 AND i = 2 THEN 2 ELSE 0 END AS double))")).alias("i", "t"))
    events = n.select("clip", F.col("node").alias("event"), F.col("node").cast("double").alias("t"), F.expr("CASE WHEN node % 4 = 0 THEN 99 ELSE node END").alias("target"), F.expr("CASE WHEN node % 3 = 0 THEN node + 1 END").alias("partner"))
    durations = n.select("clip").distinct().withColumn("duration", 3 + F.col("clip") % 3)
    found = rules.time_order(frames, ["clip", "node"], ["i"], "t", "keyframes_not_rising").unionAll(rules.event_findings(events, n.withColumn("node_id", F.col("node")), durations))
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STATES}, f AS (SELECT clip, floor(t / 86400)::BIGINT AS frame_index, CASE WHEN event_id % 9 = 0 THEN t - 200000 ELSE t END AS t FROM states), o AS (SELECT DISTINCT clip, instance || CASE WHEN event_id % 7 = 0 THEN '' ELSE '2' END AS object_id, instance AS track_id FROM states),
r AS (SELECT t - lag(t) OVER (PARTITION BY clip ORDER BY frame_index, t) AS step FROM f)
SELECT code, count(*) AS n FROM (SELECT 'repeated_frame' AS code FROM f GROUP BY clip, frame_index HAVING count(*) > 1 UNION ALL SELECT 'shared_track' FROM o GROUP BY clip, track_id HAVING count(DISTINCT object_id) > 1 UNION ALL SELECT 'frame_times_not_rising' FROM r WHERE step <= 0) GROUP BY code""")
def v3_registry_findings(spark, d):
    s = states(spark, d)
    frames = s.select("clip", F.floor(F.col("t") / 86400).cast("long").alias("frame_index"), F.expr("CASE WHEN event_id % 9 = 0 THEN t - 200000 ELSE t END").alias("t"))
    objects = s.select("clip", F.concat("instance", F.expr("CASE WHEN event_id % 7 = 0 THEN '' ELSE '2' END")).alias("object_id"), F.col("instance").alias("track_id")).distinct()
    return rules.registry_findings(frames, objects).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STATES}, p AS (SELECT clip, floor(t / 86400)::BIGINT AS frame, instance AS id, floor(y / 10)::BIGINT AS px FROM states), s AS (SELECT clip, count(DISTINCT frame) AS recorded FROM p GROUP BY clip), x AS (SELECT DISTINCT clip, 10 + clip % 5 AS frames FROM p),
v AS (SELECT clip, id, count(DISTINCT frame) AS shown FROM p WHERE px >= 4 GROUP BY ALL)
SELECT code, severity, count(*) AS n FROM (SELECT 'frame_count' AS code, 'error' AS severity FROM x JOIN s USING (clip) WHERE recorded <> frames UNION ALL SELECT 'temporarily_visible', 'warning' FROM v JOIN s USING (clip) WHERE shown < recorded) GROUP BY ALL""")
def v5_visibility(spark, d):
    p = states(spark, d).select("clip", F.floor(F.col("t") / 86400).cast("long").alias("frame"), F.col("instance").alias("id"), F.floor(F.col("y") / 10).alias("px"))
    expected = p.select("clip").distinct().withColumn("frames", 10 + F.col("clip") % 5)
    return rules.visibility_findings(p, p, expected).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STATES}, w AS (SELECT clip, instance, CASE WHEN greatest(1 + clip % 3, 2) / least(1 + clip % 3, 2)::DOUBLE < 1.6 THEN 90 ELSE 180 END AS turn, event_id, t, y FROM states), r AS (SELECT *, y - lag(y) OVER (PARTITION BY clip, instance ORDER BY t, event_id) AS d FROM w),
s AS (SELECT *, coalesce(d - turn * floor(d / turn::DOUBLE + 0.5::DOUBLE), y) AS step FROM r)
SELECT clip, instance, event_id, round(sum(step) OVER (PARTITION BY clip, instance ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM s""")
def t9_unwrap_by_aspect(spark, d):
    """A nearly square box looks the same after a quarter turn."""
    s = states(spark, d).withColumn("turn", series.heading_step((1 + F.col("clip") % 3).cast("double"), F.lit(2.0)))
    return series.unwrap_angle(s, KEYS, ["t", "event_id"], "y", F.col("turn")).select(*KEYS, "event_id", r6(F.col("unwrapped")).alias("unwrapped"))


@query(f"""WITH {STATES}, f AS (SELECT clip, instance, floor(t / 3600)::BIGINT AS frame FROM states), c AS (SELECT clip, instance, count(DISTINCT frame) AS frames, count(DISTINCT frame) / (max(frame) - min(frame) + 1) AS contiguity FROM f GROUP BY ALL)
SELECT CASE WHEN frames < 8 THEN 'short' ELSE 'long' END AS length, clip % 3 <> 0 AS matched, count(*) AS tracks, round(quantile_cont(contiguity, 0.25), 6) AS q1, round(quantile_cont(contiguity, 0.5), 6) AS median, round(quantile_cont(contiguity, 0.75), 6) AS q3 FROM c GROUP BY ALL""")
def t13_contiguity_profile(spark, d):
    tracks = series.contiguity(states(spark, d).withColumn("frame", F.floor(F.col("t") / 3600).cast("long")), KEYS, "frame").withColumn("matched", F.col("clip") % 3 != 0)
    return series.contiguity_profile(tracks, "matched", 8).withColumns({c: r6(F.col(c)) for c in ("q1", "median", "q3")})


@query(f"""WITH {STATES}, g AS (SELECT *, first(x) OVER whole AS x0, last(x) OVER whole AS x1, first(y) OVER whole AS y0, last(y) OVER whole AS y1, count(*) OVER whole AS n FROM states WINDOW whole AS (PARTITION BY clip, instance ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT clip, instance, t, CASE WHEN x0 = x1 AND y0 = y1 THEN 0 ELSE ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) END AS along FROM g)
SELECT clip, instance, count(*) AS n, round(max(along), 5) + 0.0::DOUBLE AS farthest, round(min(along), 5) + 0.0::DOUBLE AS behind FROM p GROUP BY ALL""")
def t14_along_track(spark, d):
    s = series.along_track(states(spark, d), KEYS, "t", ("x", "y"))
    return s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), (F.round(F.max("along"), 5) + F.lit(0.0)).alias("farthest"), (F.round(F.min("along"), 5) + F.lit(0.0)).alias("behind"))


@query(f"""WITH {STATES}, s AS (SELECT *, 1 + event_id % 3 AS a, 2 + event_id % 2 AS b FROM states), c AS (SELECT clip, instance, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy, sqrt(quantile_cont(a, 0.5) ** 2 + quantile_cont(b, 0.5) ** 2) AS diag, count(*) AS samples FROM s GROUP BY ALL)
SELECT clip, instance, samples, round(sqrt(avg((x - cx) ** 2 + (y - cy) ** 2)) / any_value(diag), 6) AS jitter FROM s JOIN c USING (clip, instance) WHERE samples >= 4 GROUP BY ALL""")
def t15_relative_jitter(spark, d):
    s = states(spark, d).withColumns({"a": (1 + F.col("event_id") % 3).cast("double"), "b": (2 + F.col("event_id") % 2).cast("double")})
    return series.jitter(s, KEYS, ("x", "y"), size=("a", "b")).withColumn("jitter", r6(F.col("jitter")))


@query("""SELECT l_suppkey AS object, round(max(greatest(l_quantity, 100 * l_discount, 100 * l_tax)), 6) AS longest FROM lineitem GROUP BY l_suppkey""")
def p4_longest_of_boxes(spark, d):
    boxes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("object")).agg(F.collect_set(F.array(F.col("l_quantity"), 100 * F.col("l_discount"), 100 * F.col("l_tax"))).alias("boxes"))
    return boxes.select("object", r6(C.longest_of_boxes(F.col("boxes"))).alias("longest"))


@query(f"""WITH {NODES}, f AS (SELECT DISTINCT clip, 1 + clip % 3 AS k FROM nodes WHERE clip % 4 <> 0)
SELECT clip, node, round(px * coalesce(k, 1), 6) AS px, round(ex / 2 * coalesce(k, 1), 6) AS radius, round((pz + 1) * coalesce(k, 1), 6) AS key_z, 1.5::DOUBLE AS key_t, round(CASE WHEN node % 2 = 0 THEN ey * coalesce(k, 1) ELSE ey END, 6) AS top_limit, coalesce(k, 1)::DOUBLE AS stage_scale FROM nodes LEFT JOIN f USING (clip)""")
def p10_scale_fields(spark, d):
    """Radii, key frames and slide limits are lengths; hinge limits and times are not."""
    n = nodes(spark, d).withColumns({
        "radius": F.col("ex") / 2, "keyframes": F.array(F.struct(F.lit(1.5).alias("t"), F.array("px", "py", F.col("pz") + 1).alias("pos"))), "joint": F.when(F.col("node") % 2 == 0, "slide").otherwise("hinge"), "limits": F.array(F.lit(0.0), F.col("ey"))})
    f = n.where("clip % 4 <> 0").select("clip", (1 + F.col("clip") % 3).cast("double").alias("k")).distinct()
    out = scene.scale_program(n, f, ["clip"])
    key = F.col("keyframes")[0]
    return out.select("clip", "node", r6(F.col("px")).alias("px"), r6(F.col("radius")).alias("radius"), r6(key["pos"][2]).alias("key_z"), key["t"].alias("key_t"), r6(F.col("limits")[1]).alias("top_limit"), "stage_scale")


@query(f"""WITH {NODES}, p AS (SELECT a.clip, CASE WHEN a.node % 5 = 0 OR b.node % 5 = 0 THEN 'unknown' WHEN a.class = b.class THEN 'same' ELSE 'different' END AS owners FROM nodes a JOIN nodes b ON a.clip = b.clip AND a.node < b.node AND abs(a.px - b.px) <= (a.ex + b.ex) / 2 + 1 AND abs(a.py - b.py) <= (a.ey + b.ey) / 2 + 1 AND abs(a.pz - b.pz) <= (a.ez + b.ez) / 2 + 1)
SELECT clip, owners, count(*) AS pairs FROM p GROUP BY ALL""")
def j10_touching_pairs(spark, d):
    n = nodes(spark, d).withColumn("owner", F.when(F.col("node") % 5 != 0, F.col("class")))
    return M.touching_pairs(n, ["clip"], "owner", 1.0)


@query(f"""WITH {PREDICTIONS}, j AS (SELECT 'c' || (clip % 4) AS config, sqrt((g.px - p.px) ** 2 + (g.pz - p.pz) ** 2) AS distance, abs(g.ex - p.ex) AS resize FROM nodes g JOIN predictions p USING (clip, node)), l AS (SELECT config, unnest(['distance', 'resize']) AS metric, unnest([distance, resize]) AS value FROM j)
SELECT config, metric, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median FROM l GROUP BY ALL""")
def a2_metric_summary(spark, d):
    p = predictions(spark, d).select("clip", "node", F.col("px").alias("qx"), F.col("pz").alias("qz"), F.col("ex").alias("fx"))
    j = nodes(spark, d).join(p, ["clip", "node"]).select(F.concat(F.lit("c"), F.expr("cast(clip % 4 AS string)")).alias("config"), F.sqrt(F.expr("pow(px - qx, 2) + pow(pz - qz, 2)")).alias("distance"), F.abs(F.col("ex") - F.col("fx")).alias("resize"))
    return E.metric_summary(j, "config", ["distance", "resize"]).withColumns({c: r6(F.col(c)) for c in ("mean", "std", "median")})


@query(f"""WITH {NODES}, m AS (SELECT 'c' || (clip % 4) AS config, CASE WHEN node % 3 = 0 THEN 'static' ELSE 'spin' END AS truth, CASE WHEN node % 7 = 0 THEN NULL WHEN node % 2 = 0 THEN 'static' ELSE 'spin' END AS guess FROM nodes)
SELECT config, count(*) AS n, round(avg((truth = guess)::INT), 6) AS accuracy, round(avg((truth = 'static')::INT), 6) AS always_static FROM m WHERE guess IS NOT NULL GROUP BY config""")
def a2_motion_accuracy(spark, d):
    m = nodes(spark, d).select(F.concat(F.lit("c"), F.expr("cast(clip % 4 AS string)")).alias("config"), F.expr("CASE WHEN node % 3 = 0 THEN 'static' ELSE 'spin' END").alias("truth"), F.expr("CASE WHEN node % 7 = 0 THEN NULL WHEN node % 2 = 0 THEN 'static' ELSE 'spin' END").alias("guess"))
    return E.motion_accuracy(m, "config", "truth", "guess").withColumns({c: r6(F.col(c)) for c in ("accuracy", "always_static")})


@query(f"""WITH {STATES}, m AS (SELECT instance, event_id % 8 AS level, avg(x + 4 * (event_id % 8)) AS m FROM states GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY level) AS r, m - lag(m) OVER (PARTITION BY instance ORDER BY level) AS d FROM m)
SELECT instance, count(*) AS levels, coalesce(bool_and(d >= 0), true) AS monotone, round(greatest(0, coalesce(-min(d), 0)), 6) AS worst_fall FROM r WHERE r <= 5 GROUP BY instance""")
def a12_monotone_check(spark, d):
    s = states(spark, d).select("instance", (F.col("event_id") % 8).alias("level"), F.expr("x + 4 * (event_id % 8)").alias("value"))
    return E.monotone_check(s, "instance", "level", "value").withColumn("worst_fall", r6(F.col("worst_fall")))


@query(f"""WITH {NODES}, n AS (SELECT clip, node, grp, ['floor', 'Road sign', 'wall', 'doormat', 'crate'][(node % 5 + 1)::INT] AS class, py, ey FROM nodes), s AS (SELECT *, grp = 'static' AND regexp_matches(lower(class), 'floor|ground|lawn|grass|carpet|mat|road') AS slab FROM n)
SELECT clip, node, slab, round(CASE WHEN slab THEN least(ey, 0.3) ELSE ey END, 6) AS ey, round(CASE WHEN slab THEN -least(ey, 0.3) / 2 ELSE py END, 6) + 0.0::DOUBLE AS py FROM s""")
def p7_flatten_slabs(spark, d):
    n = nodes(spark, d).withColumn("class", F.array(*[F.lit(c) for c in ("floor", "Road sign", "wall", "doormat", "crate")])[F.expr("cast(node % 5 AS int)")])
    return scene.flatten_slabs(n).select("clip", "node", "slab", r6(F.col("ey")).alias("ey"), (r6(F.col("py")) + F.lit(0.0)).alias("py"))


@query("""WITH v AS (SELECT o_orderkey AS video, sha256((o_custkey % 400)::VARCHAR) AS sha256, (o_orderkey % 11 - 1)::DOUBLE AS window_end, 'p' || (o_custkey % 400 % 9) AS program FROM orders),
a AS (SELECT c_custkey AS association, sha256((c_custkey % 450)::VARCHAR) AS video_sha256, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'confirmed' END AS status, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS shift, 8 AS duration, 'p' || (c_custkey % 450 % 8) AS program FROM customer),
g AS (SELECT video_sha256 AS sha256, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, min(association) FILTER (WHERE status = 'confirmed') AS association, arg_min(shift, association) FILTER (WHERE status = 'confirmed') AS shift, arg_min(program, association) FILTER (WHERE status = 'confirmed') AS program FROM a GROUP BY ALL),
r AS (SELECT video, association, CASE WHEN window_end <= 0 THEN 'unsupported_window' WHEN confirmed IS NULL THEN 'not_found' WHEN confirmed = 0 THEN 'review_required' WHEN confirmed > 1 THEN 'conflict' WHEN shift <> 0 THEN 'unsupported_time_mapping' WHEN window_end > 8 THEN 'window_out_of_range' WHEN v.program <> g.program THEN 'program_changed' END AS reason FROM v LEFT JOIN g USING (sha256))
SELECT video, reason, CASE WHEN reason IS NULL THEN association END::VARCHAR AS association FROM r""")
def v7_resolve_by_content(spark, d):
    """Videos to truths by content: one confirmed association, or the reason why not."""
    videos = table(spark, d, "orders").select(F.col("o_orderkey").alias("video"), F.sha2(F.expr("cast(o_custkey % 400 AS string)"), 256).alias("sha256"), F.expr("cast(o_orderkey % 11 - 1 AS double)").alias("window_end"), F.expr("concat('p', o_custkey % 400 % 9)").alias("program_sha256"))
    shift = F.expr("CASE WHEN c_custkey % 10 = 0 THEN 1D ELSE 0D END")
    known = table(spark, d, "customer").select(
        F.col("c_custkey").alias("association"), F.sha2(F.expr("cast(c_custkey % 450 AS string)"), 256).alias("video_sha256"), F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("confirmed").alias("status"), shift.alias("video_start"), F.lit(0.0).alias("program_start"),
        F.lit(1.0).alias("rate"), F.lit(8.0).alias("duration"), F.expr("concat('p', c_custkey % 450 % 8)").alias("program_sha256"))
    return rules.resolve_by_content(videos, known).select("video", "reason", F.col("association").cast("string").alias("association"))


@query(f"""WITH {STATES}, o AS (SELECT clip, instance, event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE greatest(round(x / 10), 0) * greatest(round(y / 10) - 2, 0) END AS area FROM states)
SELECT clip, instance, arg_min(event_id, row(CASE WHEN area = 0 THEN 0 ELSE -area END, event_id)) AS event_id, max(area) AS area FROM o WHERE area IS NOT NULL GROUP BY ALL""")
def r6_best_observation(spark, d):
    s = states(spark, d).select("clip", "instance", "event_id", F.lit(0.0).alias("x1"), F.lit(2.0).alias("y1"), F.when(F.col("event_id") % 6 != 0, F.round(F.col("x") / 10)).alias("x2"), F.round(F.col("y") / 10).alias("y2"))
    return R.best_observation(s, KEYS, ["event_id"]).select(*KEYS, "event_id", "area")


@query(f"""WITH {STATES}, c AS (SELECT clip, instance, max(x) AS best, list_reverse_sort(list(x))[2] AS second FROM states WHERE event_id % 5 <> 0 GROUP BY ALL), o AS (SELECT clip, instance, CASE WHEN clip % 3 = 0 THEN min(y) END AS attribute_conf, CASE WHEN clip % 2 = 0 THEN max(y) END AS guess_conf, CASE WHEN clip % 4 = 0 THEN 0.5::DOUBLE END AS stated FROM states GROUP BY clip, instance)
SELECT clip, instance, coalesce(attribute_conf, guess_conf) AS primary, best, round(coalesce(stated, best - second), 6) AS margin FROM o LEFT JOIN c USING (clip, instance)""")
def a6_primary_support(spark, d):
    """What is unknown falls back: attribute, then guess; the stated margin, then that of the candidates."""
    s = states(spark, d)
    o = s.groupBy(*KEYS).agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select(*KEYS, F.when(F.col("clip") % 3 == 0, F.col("lo")).alias("attribute_conf"), F.when(F.col("clip") % 2 == 0, F.col("hi")).alias("guess_conf"), F.when(F.col("clip") % 4 == 0, 0.5).alias("stated_margin"))
    c = s.select(*KEYS, F.when(F.col("event_id") % 5 != 0, F.col("x")).alias("confidence"))
    return E.primary_support(o, c, KEYS).withColumn("margin", r6(F.col("margin")))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT clip, avg((node % 3 <> 0)::INT) AS asset_coverage FROM nodes WHERE grp = 'object' GROUP BY clip), e AS (SELECT DISTINCT clip, class || ' #' || (node % 6) AS id, class || '_' || (node % 6) AS slug FROM nodes), p AS (SELECT DISTINCT clip, CASE WHEN node % 2 = 0 THEN class || '_' || (node % 6) ELSE class || ' #' || (node % 6) END AS id FROM predictions),
h AS (SELECT e.clip, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p WHERE p.clip = e.clip AND p.id IN (e.id, e.slug))) AS hit FROM e GROUP BY e.clip)
SELECT clip, round(asset_coverage, 6) AS asset_coverage, round(hit / n, 6) AS object_recall FROM r FULL JOIN h USING (clip)""")
def a7_coverage_and_recall(spark, d):
    n = nodes(spark, d)
    requests = n.where("grp = 'object'").select("clip", F.when(F.col("node") % 3 != 0, "library:" ).otherwise("fallback").alias("resolved"))
    evidence = n.select("clip", F.concat("class", F.lit(" #"), F.expr("cast(node % 6 AS string)")).alias("id"))
    found = predictions(spark, d).select("clip", F.concat("class", F.when(F.col("node") % 2 == 0, "_").otherwise(" #"), F.expr("cast(node % 6 AS string)")).alias("id"))
    return E.coverage_and_recall(requests, evidence, found, "clip").withColumns({c: r6(F.col(c)) for c in ("asset_coverage", "object_recall")})


@query(f"""WITH {STATES}, p AS (SELECT clip, CASE length(instance) % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'slide' ELSE 'hinge' END AS mode, x / 100 AS lift, y / 300 AS follow, x / 150 AS speed, y < 80 AS moves, x / 4000 AS drift, CASE WHEN event_id % 3 = 0 THEN NULL ELSE y / 40 END AS overshoot, event_id % 9 = 0 AS fell FROM states),
k AS (SELECT clip, CASE mode WHEN 'free' THEN lift >= 0.5 AND follow <= 0.25 AND NOT fell AND speed < 0.5 WHEN 'slide' THEN moves AND drift <= 0.02 AND coalesce(overshoot, 0) <= 0.02 ELSE moves AND coalesce(overshoot, 0) <= 2 END AS ok FROM p),
o AS (SELECT DISTINCT clip, (40 + clip % 30) AS n FROM states), g AS (SELECT clip, count(*) AS declared, count(*) FILTER (WHERE ok) AS works FROM k GROUP BY clip)
SELECT clip, n AS objects, declared, works, round(works / declared, 6) AS success_share, round(works / n, 6) AS interactive_share FROM o JOIN g USING (clip)""")
def a8_declared_and_measured(spark, d):
    """Free, sliding and hinged objects by their own rules, next to what was declared."""
    mode = F.expr("CASE length(instance) % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'slide' ELSE 'hinge' END")
    s = states(spark, d)
    p = s.select("clip", mode.alias("mode"), (F.col("x") / 100).alias("lift"), (F.col("y") / 300).alias("follow"), (F.col("x") / 150).alias("speed"), (F.col("y") < 80).alias("moves"), (F.col("x") / 4000).alias("drift"),
                 F.when(F.col("event_id") % 3 != 0, F.col("y") / 40).alias("overshoot"), F.lit(True).alias("finite"), (F.col("event_id") % 9 == 0).alias("fell"))
    objects = s.select("clip", (40 + F.col("clip") % 30).alias("n")).distinct()
    return E.declared_and_measured(E.interaction_success(p), objects, "clip").withColumns({c: r6(F.col(c)) for c in ("success_share", "interactive_share")})


@query("""WITH f AS (SELECT p_size % 10 AS query, p_partkey AS asset_id, row_number() OVER (PARTITION BY p_size % 10 ORDER BY p_retailprice, p_partkey) AS rank FROM part), s AS (SELECT p_size % 10 AS query, p_partkey AS asset_id, row_number() OVER (PARTITION BY p_size % 10 ORDER BY p_name, p_partkey) AS rank FROM part),
t AS (SELECT DISTINCT p_size % 10 AS query, p_partkey AS asset_id FROM part WHERE p_partkey % 17 = 0), b AS (SELECT query, (SELECT min(rank) FROM f SEMI JOIN t USING (query, asset_id) WHERE f.query = q.query) AS f, (SELECT min(rank) FROM s SEMI JOIN t USING (query, asset_id) WHERE s.query = q.query) AS s FROM (SELECT DISTINCT query FROM f) q)
SELECT query, coalesce(f <= 16, false) AS first, coalesce(s <= 16, false) AS second, coalesce(f <= 8, false) OR coalesce(s <= 8, false) AS both FROM b""")
def r9_union_budget(spark, d):
    """Two rankings of all assets for ten queries, each with its own truths."""
    from pyspark.sql import Window

    part = table(spark, d, "part").withColumn("query", F.col("p_size") % 10)
    ranked = lambda c: part.select("query", F.col("p_partkey").alias("asset_id"), F.row_number().over(Window.partitionBy("query").orderBy(c, "p_partkey")).alias("rank"))
    truths = part.where("p_partkey % 17 = 0").select("query", F.col("p_partkey").alias("asset_id"))
    return R.union_budget(ranked("p_retailprice"), ranked("p_name"), truths, ["query"], 16)


@query(f"""WITH {NODES}, h AS (SELECT clip, node, 0::DOUBLE AS ux, 0.6::DOUBLE AS uy, 0.8::DOUBLE AS uz, radians(20 + node * 10) AS a, px AS tx, py AS ty, pz AS tz, ex AS qx, ey AS qy, ez AS qz FROM nodes),
c AS (SELECT *, uy * ty + uz * tz AS d FROM h), x AS (SELECT *, tx AS cx, ty - uy * d AS cy, tz - uz * d AS cz FROM c), p AS (SELECT *, (cx + (uy * cz - uz * cy) / tan(a / 2)) / 2 AS p0, (cy + (uz * cx) / tan(a / 2)) / 2 AS p1, (cz - (uy * cx) / tan(a / 2)) / 2 AS p2 FROM x),
s AS (SELECT *, uy * (qy - p1) + uz * (qz - p2) AS l FROM p)
SELECT clip, node, round(p0, 5) + 0.0::DOUBLE AS x, round(p1 + uy * l, 5) + 0.0::DOUBLE AS y, round(p2 + uz * l, 5) + 0.0::DOUBLE AS z FROM s""")
def g5_hinge_pivot(spark, d):
    n = nodes(spark, d)
    p = G.hinge_pivot([F.lit(0.0), F.lit(0.6), F.lit(0.8)], F.radians(20 + F.col("node") * 10), [F.col(c) for c in ("px", "py", "pz")], [F.col(c) for c in ("ex", "ey", "ez")])
    return n.select("clip", "node", *[(F.round(v, 5) + F.lit(0.0)).alias(c) for c, v in zip("xyz", p)])


_TRUE = f"""{NODES}, t AS (SELECT clip, node, px, CASE WHEN node % 3 = 0 THEN 'static' ELSE 'swing' END AS motion, 1 + pz AS period FROM nodes)"""


@query(f"""WITH {_TRUE}, v AS (SELECT 'base' AS variant, * FROM t UNION ALL SELECT 'drop', * FROM t WHERE node % 4 <> 0 UNION ALL SELECT 'ghost', * FROM t UNION ALL SELECT 'ghost', clip, node + 1000, px + 6, motion, period FROM t WHERE node = 1
  UNION ALL SELECT 'period', * REPLACE (period * 1.25::DOUBLE AS period) FROM t UNION ALL SELECT 'type', * REPLACE (CASE WHEN node % 2 = 0 THEN 'static' ELSE motion END AS motion) FROM t UNION ALL SELECT 'move_one', * REPLACE (px + CASE WHEN node = 1 THEN 0.5::DOUBLE ELSE 0 END AS px) FROM t),
j AS (SELECT v.variant, t.clip IS NOT NULL AS hit, abs(v.px - t.px) AS err, (v.motion = t.motion)::INT AS right_type, abs(v.period - t.period) AS period_err FROM v LEFT JOIN t USING (clip, node)), n AS (SELECT count(*) AS n FROM t),
s AS (SELECT variant, count(*) FILTER (WHERE hit) / (SELECT n FROM n) AS recall, count(*) FILTER (WHERE hit) / count(*) AS precision, avg(err) AS error, avg(right_type) AS accuracy, avg(period_err) AS period_error FROM j GROUP BY variant),
l AS (SELECT variant, unnest(['recall', 'precision', 'error', 'accuracy', 'period_error']) AS metric, unnest([recall, precision, error, accuracy, period_error]) AS value FROM s),
d AS (SELECT l.variant, l.metric, l.value - b.value AS delta FROM l JOIN l b ON b.variant = 'base' AND b.metric = l.metric WHERE l.variant <> 'base'),
e AS (SELECT unnest(['drop', 'drop', 'ghost', 'ghost', 'period', 'period', 'type', 'type', 'move_one', 'move_one']) AS variant, unnest(['recall', 'precision', 'precision', 'recall', 'period_error', 'accuracy', 'accuracy', 'error', 'error', 'accuracy']) AS metric, unnest([-1, 0, -1, 0, 1, 0, -1, 0, 1, 0]) AS way)
SELECT variant, metric, round(delta, 6) + 0.0::DOUBLE AS delta, CASE WHEN way = 0 THEN abs(delta) <= 1e-6 WHEN way IS NOT NULL THEN sign(delta) = way END AS as_expected FROM d LEFT JOIN e USING (variant, metric)""")
def a13_corruptions(spark, d):
    """Each corruption moves the metric it should, and no other that is named."""
    t = nodes(spark, d).select("clip", "node", "px", F.expr("CASE WHEN node % 3 = 0 THEN 'static' ELSE 'swing' END").alias("motion"), (1 + F.col("pz")).alias("period"))
    v = E.perturb(
        t, {"base": {}, "period": {"period": F.col("period") * 1.25}, "type": {"motion": F.expr("CASE WHEN node % 2 = 0 THEN 'static' ELSE motion END")}, "move_one": {"px": F.expr("px + CASE WHEN node = 1 THEN 0.5D ELSE 0 END")}},
        {"drop": F.col("node") % 4 == 0}, {"ghost": (F.col("node") == 1, {"node": F.col("node") + 1000, "px": F.col("px") + 6})})
    truth = t.select("clip", "node", F.col("px").alias("g"), F.col("motion").alias("gm"), F.col("period").alias("gp"))
    n = t.count()
    hit = F.col("g").isNotNull()
    scores = v.join(truth, ["clip", "node"], "left").groupBy("variant").agg(
        (F.count_if(hit) / F.lit(n)).alias("recall"), (F.count_if(hit) / F.count(F.lit(1))).alias("precision"), F.avg(F.abs(F.col("px") - F.col("g"))).alias("error"),
        F.avg((F.col("motion") == F.col("gm")).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("period") - F.col("gp"))).alias("period_error"))
    ways = {"drop": {"recall": -1, "precision": 0}, "ghost": {"precision": -1, "recall": 0}, "period": {"period_error": 1, "accuracy": 0}, "type": {"accuracy": -1, "error": 0}, "move_one": {"error": 1, "accuracy": 0}}
    out = E.sensitivity(scores, "base", ["recall", "precision", "error", "accuracy", "period_error"], ways)
    return out.withColumn("delta", r6(F.col("delta")) + F.lit(0.0))


@query(f"""WITH {NODES}, l AS (SELECT unnest([0.15, 0.4, 0.8, 1.6]::DOUBLE[]) AS level) SELECT level, count(*) AS n, round(avg(level + 0.1::DOUBLE * (node % 3)), 6) AS error FROM nodes, l GROUP BY level""")
def a13_graded_shifts(spark, d):
    n = nodes(spark, d).withColumn("g", F.col("px"))
    moved = E.graded(n.withColumn("px", F.expr("px + 0.1D * (node % 3)")), [0.15, 0.4, 0.8, 1.6], "px")
    return moved.groupBy("level").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("px") - F.col("g")))).alias("error"))


@query(f"""WITH {PREDICTIONS}, j AS (SELECT g.grp, p.ey / g.ey AS h, greatest(p.ex, p.ey, p.ez) / greatest(g.ex, g.ey, g.ez) AS l FROM nodes g JOIN predictions p USING (clip, node)), q AS (SELECT grp, count(*) AS n, quantile_cont(h, [0.25, 0.5, 0.75]) AS h, quantile_cont(l, [0.25, 0.5, 0.75]) AS l FROM j GROUP BY grp)
SELECT grp, n, round(h[1], 6) AS height_q1, round(h[2], 6) AS height_median, round(h[3], 6) AS height_q3, round(l[1], 6) AS edge_q1, round(l[2], 6) AS edge_median, round(l[3], 6) AS edge_q3 FROM q""")
def a15_dimension_ratios(spark, d):
    p = predictions(spark, d).select("clip", "node", *[F.col(f"e{c}").alias(f"q{c}") for c in "xyz"])
    out = E.dimension_ratios(nodes(spark, d).join(p, ["clip", "node"]), "grp")
    return out.select("grp", "n", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query(f"""WITH {NODES}, a AS (SELECT clip, node, px, py, pz FROM nodes WHERE node % 6 <> 0), b AS (SELECT clip, node, px + CASE WHEN node % 4 = 0 THEN 0.2::DOUBLE ELSE 0 END AS px, py - 0.001::DOUBLE AS py, pz FROM nodes WHERE node % 5 <> 0),
j AS (SELECT coalesce(a.clip, b.clip) AS clip, a.clip IS NOT NULL AS ina, b.clip IS NOT NULL AS inb, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2) AS far FROM a FULL JOIN b USING (clip, node))
SELECT clip, count(*) FILTER (WHERE ina AND inb) AS shared, count(*) FILTER (WHERE NOT inb) AS lost, count(*) FILTER (WHERE NOT ina) AS new, count(*) FILTER (WHERE far >= 0.01) AS moved, round(max(far), 6) AS farthest FROM j GROUP BY clip""")
def a16_displaced_sets(spark, d):
    n = nodes(spark, d).select("clip", F.col("node").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    after = n.where("id % 5 <> 0").withColumns({"x": F.expr("x + CASE WHEN id % 4 = 0 THEN 0.2D ELSE 0 END"), "y": F.col("y") - 0.001})
    return E.displaced_sets(n.where("id % 6 <> 0"), after, ["clip"]).withColumn("farthest", r6(F.col("farthest")))

"""Queries of declared motions: orientations between key frames, and parameters from guesses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneloom.operators import motion as N
from sceneloom.plans.adapters import NODES, STATES, nodes, states
from sceneloom.plans.registry import query

TIMES = (-1.0, 0.25, 1.0, 1.5, 1.9, 3.0)


@query(f"""
WITH {NODES},
p AS (SELECT clip, node, t, 40 * node AS a, (40 * node + 540) % 360 - 180 AS there, ((-30 - 40 * node) % 360 + 900) % 360 - 180 AS back FROM nodes, (SELECT unnest({list(TIMES)!r}::DOUBLE[]) AS t)),
v AS (SELECT *, radians(CASE WHEN t <= 0 THEN 0 WHEN t <= 1 THEN there * t WHEN t <= 2 THEN a + back * (t - 1) ELSE -30 END) AS turn FROM p)
SELECT node, t, count(*) AS n, round(avg(sin(turn)), 5) + 0.0::DOUBLE AS sine, round(avg(cos(turn)), 5) + 0.0::DOUBLE AS cosine FROM v GROUP BY ALL""")
def t11_keyframe_turns(spark, d):
    """Nodes that turn about the vertical by key frames, the short way: sine and cosine of where they look."""
    def about_y(degrees: Column) -> Column:
        # Both signs stand for the same turn; every other one is given with the other sign.
        half = F.radians(degrees) / 2
        sign = F.when(F.col("node") % 2 == 0, -1.0).otherwise(1.0)
        return F.array(F.lit(0.0), sign * F.sin(half), F.lit(0.0), sign * F.cos(half))

    frame = lambda t, angle: F.struct(F.lit(t).alias("t"), F.array("px", "py", "pz").alias("pos"), angle.alias("quat"))
    flat = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    frames = F.array(frame(0.0, F.lit(None).cast("array<double>")), frame(1.0, about_y(40.0 * F.col("node"))), frame(2.0, about_y(F.lit(-30.0))))
    n = nodes(spark, d).select(
        "clip", "node", F.lit("trajectory").alias("motion"), F.array("px", "py", "pz").alias("pos"), flat.alias("quat"), F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0)]).alias("axis"), F.lit(0.0).alias("start"), F.lit(0.0).alias("rate"),
        F.lit(0.0).alias("amp"), F.lit(1.0).alias("period"), F.lit(0.0).alias("phase"), F.lit(None).cast(N.SCHEDULE).alias("schedule"), frames.alias("keyframes"), F.lit(False).alias("smooth"))
    y, w = F.col("quat")[1], F.col("quat")[3]
    s = N.sample_motion(n, F.array(*[F.lit(t) for t in TIMES]))
    out = s.groupBy("node", "t").agg(F.count(F.lit(1)).alias("n"), F.avg(2 * y * w).alias("sine"), F.avg(w * w - y * y).alias("cosine"))
    return out.select("node", "t", "n", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("sine", "cosine")])


KIND = "['periodic_translate', 'periodic_rotate', 'spin', 'revolute', 'prismatic', 'static']"


@query(f"""
WITH {STATES},
spans AS (SELECT clip, min(t) AS t0 FROM states GROUP BY clip),
tracks AS (
  SELECT clip, instance, list({{'t': (t - t0) / 86400, 'x': x, 'z': y}} ORDER BY t, x) AS seen, avg(x) AS mx, avg(y) AS mz, count(*) AS n, {KIND}[(clip + length(instance)) % 6 + 1] AS kind, clip % 4 <> 0 AS hinged
  FROM states JOIN spans USING (clip) GROUP BY clip, instance),
f AS (
  SELECT *, seen[1].t AS first_t, seen[n].t - seen[1].t AS span, 0.6::DOUBLE * (seen[1].x - mx) + 0.8::DOUBLE * (seen[1].z - mz) AS p0,
         0.6::DOUBLE * (seen[least(n, 3)].x - mx) + 0.8::DOUBLE * (seen[least(n, 3)].z - mz) AS p2, CASE WHEN clip % 3 = 0 THEN 0.1::DOUBLE ELSE 90::DOUBLE END AS amp,
         CASE WHEN kind = 'prismatic' OR kind = 'revolute' AND NOT hinged THEN 'trajectory' ELSE kind END AS motion
  FROM tracks WHERE n >= 2 AND kind <> 'static'),
g AS (SELECT *, asin(greatest(least(p0 / amp, 1), -1)) AS phi FROM f),
h AS (SELECT *, CASE WHEN cos(phi) * (p2 - p0) < 0 THEN pi() - phi ELSE phi END AS branch FROM g)
SELECT clip, instance, motion, CASE WHEN motion LIKE 'periodic%' THEN round(mx, 6) END AS centre,
       CASE motion WHEN 'periodic_translate' THEN amp WHEN 'periodic_rotate' THEN 30 END::DOUBLE AS amp,
       round(CASE motion WHEN 'periodic_translate' THEN 7 WHEN 'periodic_rotate' THEN greatest(span, 1) * 2 END, 5) AS period,
       round(CASE motion WHEN 'periodic_translate' THEN branch - 2 * pi() * first_t / 7 WHEN 'periodic_rotate' THEN 0 END, 4) + 0.0::DOUBLE AS phase,
       CASE motion WHEN 'spin' THEN 90 END::DOUBLE AS rate, CASE motion WHEN 'revolute' THEN greatest(10 * (clip % 5), 5) END::DOUBLE AS opens,
       CASE motion WHEN 'revolute' THEN round(greatest(span, 0.5::DOUBLE), 5) END AS lasts, CASE motion WHEN 'trajectory' THEN least(n, 12) END::DOUBLE AS frames
FROM h""")
def p8_motion_branches(spark, d):
    """Parameters of all objects' motions from guesses dealt to them: phases by branch, hinges by one move, the rest by key frames."""
    s = states(spark, d)
    kind = F.array(*[F.lit(k) for k in ("periodic_translate", "periodic_rotate", "spin", "revolute", "prismatic", "static")])
    g = s.select("clip", "instance").distinct().select(
        "clip", "instance", kind[F.expr("cast((clip + length(instance)) % 6 AS int)")].alias("type"), F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8)).alias("axis"),
        F.expr("CASE WHEN clip % 3 = 0 THEN NULL ELSE 90D END").alias("amp"), F.lit(None).cast("double").alias("amp_deg"), F.expr("CASE WHEN (clip + length(instance)) % 6 = 0 THEN 7D END").alias("period"),
        F.lit(None).cast("double").alias("phase"), F.lit(0.0).alias("rate"), F.when(F.col("clip") % 4 != 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("pivot"), F.array(F.lit(0.0), F.expr("10D * (clip % 5)")).alias("range_deg"))
    start = s.groupBy("clip").agg(F.min("t").alias("t0"))
    track = s.join(start, "clip").select("clip", "instance", ((F.col("t") - F.col("t0")) / 86400).alias("t"), "x", F.lit(0.0).alias("y"), F.col("y").alias("z"))
    out = N.motion_from_guess(g, track, ["clip", "instance"])
    rounded = lambda c, n=5: F.round(c, n) + F.lit(0.0)
    return out.select(
        "clip", "instance", "motion", F.round(F.col("pos")[0], 6).alias("centre"), "amp", F.round("period", 5).alias("period"), rounded(F.col("phase"), 4).alias("phase"), "rate", F.col("range_deg")[1].alias("opens"),
        F.round(F.col("schedule")[0]["duration"], 5).alias("lasts"), F.when(F.col("keyframes").isNotNull(), F.size("keyframes").cast("double")).alias("frames"))

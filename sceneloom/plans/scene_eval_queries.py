"""Queries of the scene evaluation: scale from cameras, errors of frozen pairs, agreement of matched nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.columns import r6
from sceneloom.operators import scene_evaluation as S
from sceneloom.plans.adapters import STATES, states
from sceneloom.plans.registry import query
from sceneloom.shared import stored


def scenes(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, nodes and cameras of both sides from the events: an event type is a node of its user's clip.

    Predictions leave some nodes out, shift the rest, shrink every third clip, and take some structures for objects.
    """
    s = states(spark, d).select("clip", "instance", "t", "x", F.lit(0.5).alias("y"), F.col("y").alias("z"))
    s = s.withColumn("kind", F.when(F.col("instance").isin("error", "signup"), "static").otherwise("object"))
    truth = s.select(F.lit("gt").alias("side"), "clip", "kind", "instance", F.col("instance").alias("node"), "t", "x", "y", "z")
    shrink = "CASE WHEN clip % 3 = 0 THEN 0.5D ELSE 1D END"
    guess = s.where("(clip + length(instance)) % 6 <> 0").select(
        F.lit("pred").alias("side"), "clip", F.expr("CASE WHEN clip % 5 = 0 AND instance = 'signup' THEN 'object' ELSE kind END").alias("kind"), F.concat(F.lit("p_"), "instance").alias("instance"),
        F.concat(F.lit("p_"), "instance").alias("node"), "t", F.expr(f"{shrink} * (x + 0.5D * (clip % 3))").alias("x"), "y", F.expr(f"{shrink} * (z + 0.25D)").alias("z"))
    both = truth.unionByName(guess)
    pick = lambda *k: F.array(*[F.lit(x) for x in k])
    deal = lambda n: F.expr(f"cast(pmod(clip + length(instance) + CASE WHEN side = 'pred' AND (clip div 4) % 3 = 0 THEN 1 ELSE 0 END, {n}) AS int)")
    size = F.expr("1D + clip % 3")
    nodes_ = both.select("side", "clip", "node", "instance").distinct().select(
        "side", "clip", "node", F.regexp_replace("instance", "^p_(click|view)$", "$1").alias("class"), pick("static", "linear", "revolute")[deal(3)].alias("motion"), pick("box", "sphere", "mesh", "cylinder")[deal(4)].alias("shape"),
        F.array(size, F.lit(1.0), F.when(F.col("side") == "pred", size).otherwise(F.lit(2.0))).alias("extent"), F.when((F.col("side") == "pred") & (F.col("clip") % 2 == 0), F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25))).alias("asset_ratios"))
    shot = s.where("instance = 'view' AND clip % 7 <> 0").select("clip", "t", "x", F.lit(1.5).alias("y"), "z")
    k = F.when(F.col("side") == "pred", F.expr(shrink)).otherwise(1.0)
    cameras = shot.withColumn("side", F.explode(F.array(F.lit("gt"), F.lit("pred")))).where("side = 'gt' OR floor(t) % 5 <> 0").select("side", "clip", "t", *[(k * F.col(c)).alias(c) for c in ("x", "y", "z")])
    return both, nodes_, cameras


SHRINK = "CASE WHEN clip % 3 = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END"
SPANS = "spans AS (SELECT clip, min(t) AS t0, max(t) AS t1, min(t) + (max(t) - min(t)) * 0.8::DOUBLE AS cut FROM states GROUP BY clip HAVING max(t) > min(t))"
#: Both sides of all tracks, predictions under the names of their truths.
SIDES = f"""{STATES},
{SPANS},
sides AS (
  SELECT 'gt' AS side, clip, instance, CASE WHEN instance IN ('error', 'signup') THEN 'static' ELSE 'object' END AS kind, t, x, 0.5::DOUBLE AS y, y AS z FROM states
  UNION ALL
  SELECT 'pred', clip, instance, CASE WHEN instance = 'error' OR instance = 'signup' AND clip % 5 <> 0 THEN 'static' ELSE 'object' END, t,
         {SHRINK} * (x + 0.5::DOUBLE * (clip % 3)), 0.5::DOUBLE, {SHRINK} * (y + 0.25::DOUBLE)
  FROM states WHERE (clip + length(instance)) % 6 <> 0)"""


def _at(asks: str, samples: str, keys: str, p: str, more: str) -> str:
    """Linear interpolation of x, y, z of ``samples`` at the times of ``asks``, by the neighbours on both sides."""
    on = " AND ".join(f"q.{k} = s.{k}" for k in keys.split(", "))
    axis = lambda c: f"CASE WHEN b.t > a.t THEN a.{c} + (b.{c} - a.{c}) * (q.t - a.t) / (b.t - a.t) ELSE a.{c} END AS {p}{c}"
    side = lambda op: f"(SELECT q.*, s.t AS st, s.x, s.y, s.z FROM {asks} q ASOF JOIN {samples} s ON {on} AND q.t {op} s.t)"
    return f"""SELECT {more}, {", ".join(axis(c) for c in "xyz")}
  FROM {asks} q JOIN (SELECT * EXCLUDE (t, st), st AS t, t AS at FROM {side(">=")}) a ON {" AND ".join(f"q.{k} = a.{k}" for k in keys.split(", "))} AND q.j = a.j
  JOIN (SELECT * EXCLUDE (t, st), st AS t, t AS at FROM {side("<=")}) b ON {" AND ".join(f"q.{k} = b.{k}" for k in keys.split(", "))} AND q.j = b.j"""


@query(f"""
WITH {SIDES},
centres AS (SELECT side, clip, instance, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM sides JOIN spans USING (clip) WHERE kind = 'object' AND t <= cut GROUP BY ALL),
spread AS (
  SELECT clip, coalesce(max(r) FILTER (WHERE side = 'gt'), 0) AS gt_spread, coalesce(max(r) FILTER (WHERE side = 'pred'), 0) AS pred_spread
  FROM (SELECT clip, side, CASE WHEN count(*) >= 2 THEN sqrt(var_pop(x) + var_pop(y) + var_pop(z)) ELSE 0 END AS r FROM centres GROUP BY clip, side) GROUP BY clip),
cam AS (
  SELECT side, clip, t, k * x AS x, k * 1.5::DOUBLE AS y, k * y AS z
  FROM (SELECT *, unnest(['gt', 'pred']) AS side FROM states WHERE instance = 'view' AND clip % 7 <> 0) JOIN spans USING (clip),
       LATERAL (SELECT CASE WHEN side = 'pred' THEN {SHRINK} ELSE 1::DOUBLE END AS k)
  WHERE (side = 'gt' OR floor(t) % 5 <> 0) AND t <= cut),
per AS (SELECT clip, side, count(*) AS n, count(DISTINCT t) AS m, min(t) AS lo, max(t) AS hi FROM cam GROUP BY clip, side),
one AS (
  SELECT spans.clip, g.lo IS NULL OR p.lo IS NULL OR g.n < 2 OR p.n < 2 AS few, g.m < g.n OR p.m < p.n AS again, greatest(g.lo, p.lo) AS lo, least(g.hi, p.hi) AS hi
  FROM spans LEFT JOIN per g ON g.clip = spans.clip AND g.side = 'gt' LEFT JOIN per p ON p.clip = spans.clip AND p.side = 'pred'),
asks AS (
  SELECT clip, unnest(['gt', 'pred']) AS side, j, CASE WHEN j = 119 THEN hi ELSE lo + (hi - lo) * j / 119::DOUBLE END AS t
  FROM one, (SELECT unnest(range(120)) AS j) WHERE NOT few AND NOT again AND hi > lo),
placed AS ({_at("asks", "cam", "clip, side", "", "q.clip, q.side, q.j")}),
radii AS (SELECT clip, side, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS r FROM placed GROUP BY clip, side),
told AS (
  SELECT one.clip, CASE WHEN few THEN 'too_few' WHEN again THEN 'repeated_time' WHEN hi <= lo THEN 'no_common_span'
           WHEN gt_spread > 0 AND g.r < 0.1::DOUBLE * gt_spread OR pred_spread > 0 AND p.r < 0.1::DOUBLE * pred_spread THEN 'still_camera' WHEN p.r <= 1e-9 OR g.r <= 0 THEN 'degenerate' END AS why, g.r AS gr, p.r AS pr
  FROM one LEFT JOIN radii g ON g.clip = one.clip AND g.side = 'gt' LEFT JOIN radii p ON p.clip = one.clip AND p.side = 'pred' LEFT JOIN spread ON spread.clip = one.clip)
SELECT clip, CASE WHEN why IS NULL THEN 'camera' ELSE 'none' END AS used, why, round(CASE WHEN why IS NULL THEN gr / pr ELSE 1 END, 4) AS scale FROM told""")
def j6_camera_scale(spark, d):
    both, _, cameras = scenes(spark, d)
    both = stored(both, "states")
    spans = both.where("side = 'gt'").groupBy("clip").agg(F.min("t").alias("begin"), F.max("t").alias("t1")).where("t1 > begin")
    spans = spans.select("clip", "begin", F.expr("begin + (t1 - begin) * 0.8D").alias("end"))
    centres = both.join(spans, "clip").where("kind = 'object' AND t <= end").groupBy("side", "clip", "instance").agg(*[F.avg(c).alias(c) for c in S.AXES])
    spread = centres.groupBy("clip", "side").agg(S.rms_radius(*S.AXES).alias("r")).groupBy("clip").pivot("side", ["gt", "pred"]).agg(F.first("r"))
    spread = spread.select("clip", F.coalesce("gt", F.lit(0.0)).alias("gt_spread"), F.coalesce("pred", F.lit(0.0)).alias("pred_spread"))
    return S.camera_scale(cameras, spans, spread).select("clip", "used", "why", F.round("scale", 4).alias("scale"))


@query(f"""
WITH {SIDES},
ends AS (SELECT side, clip, instance, min(t) AS a, max(t) AS b FROM sides GROUP BY ALL),
windows AS (SELECT clip, 'fit' AS win, t0 AS w0, cut AS w1 FROM spans UNION ALL SELECT clip, 'full', t0, t1 FROM spans UNION ALL SELECT clip, 'holdout', cut, t1 FROM spans),
pairs AS (
  SELECT w.clip, g.instance, win, greatest(w0, g.a, p.a) AS lo, least(w1, g.b, p.b) AS hi, w0, w1
  FROM windows w JOIN ends g ON g.clip = w.clip AND g.side = 'gt' JOIN ends p ON p.clip = w.clip AND p.side = 'pred' AND p.instance = g.instance),
judged AS (SELECT *, greatest(hi - lo, 0) / (w1 - w0) AS coverage, hi > lo AND greatest(hi - lo, 0) / (w1 - w0) >= 0.5::DOUBLE AS enough FROM pairs),
asks AS (SELECT clip, instance, win, j, CASE WHEN j = 119 THEN hi ELSE lo + (hi - lo) * j / 119::DOUBLE END AS t FROM judged, (SELECT unnest(range(120)) AS j) WHERE enough),
truth AS (SELECT *, unnest(['fit', 'full', 'holdout']) AS win FROM sides WHERE side = 'gt'),
guess AS (SELECT *, unnest(['fit', 'full', 'holdout']) AS win FROM sides WHERE side = 'pred'),
at_truth AS ({_at("asks", "truth", "clip, instance, win", "g", "q.clip, q.instance, q.win, q.j")}),
at_guess AS ({_at("asks", "guess", "clip, instance, win", "p", "q.clip, q.instance, q.win, q.j")}),
far AS (
  SELECT clip, instance, win, avg(sqrt((gx - px) ** 2 + (gy - py) ** 2 + (gz - pz) ** 2)) AS d FROM at_truth JOIN at_guess USING (clip, instance, win, j) GROUP BY ALL)
SELECT clip, instance, win AS "window", round(coverage, 6) AS coverage, round(d, 4) AS distance, CASE WHEN NOT enough THEN 'insufficient_time_coverage' END AS reason
FROM judged LEFT JOIN far USING (clip, instance, win)""")
def a1_window_errors(spark, d):
    """Pairs of the same name in all three windows, without a gauge."""
    both, _, _ = scenes(spark, d)
    tracks = stored(S.build_scene_tracks(both), "tracks")
    spans = tracks.where("side = 'gt'").groupBy("clip").agg(F.min(F.element_at("samples", 1)["t"]).alias("t0"), F.max(F.element_at("samples", -1)["t"]).alias("t1")).where("t1 > t0")
    spans = spans.withColumn("cut", F.expr("t0 + (t1 - t0) * 0.8D"))
    windows = F.array(*[F.struct(F.lit(n).alias("window"), F.col(a).alias("w0"), F.col(b).alias("w1")) for n, a, b in (("fit", "t0", "cut"), ("full", "t0", "t1"), ("holdout", "cut", "t1"))])
    asked = spans.select("clip", F.explode(windows).alias("w")).select("clip", "w.*")
    side = lambda s, name: tracks.where(F.col("side") == s).select("clip", F.regexp_replace("instance", "^p_", "").alias("instance"), F.col("samples").alias(name))
    zero = F.lit(0.0)
    pairs = side("gt", "g").join(side("pred", "p"), ["clip", "instance"]).select("*", F.lit(1.0).alias("scale"), zero.alias("yaw"), zero.alias("tx"), zero.alias("tz"))
    out = S.window_errors(pairs, asked, S.SceneParams(coverage=0.5))
    return out.select("clip", "instance", "window", r6(F.col("coverage")).alias("coverage"), F.round("distance", 4).alias("distance"), "reason")


PAIRED = f"""{STATES},
ids AS (SELECT DISTINCT clip, instance FROM states),
found AS (SELECT * FROM ids WHERE (clip + length(instance)) % 6 <> 0),
paired AS (
  SELECT clip, instance AS truth_class, CASE WHEN instance IN ('click', 'view') THEN instance ELSE 'p_' || instance END AS class, 1 + clip % 3 AS size,
         ['static', 'linear', 'revolute'][((clip + length(instance)) % 3 + 1)::BIGINT] AS gt_motion,
         ['static', 'linear', 'revolute'][((clip + length(instance) + 2 + CASE WHEN (clip // 4) % 3 = 0 THEN 1 ELSE 0 END) % 3 + 1)::BIGINT] AS pred_motion,
         ['box', 'sphere', 'mesh', 'cylinder'][((clip + length(instance)) % 4 + 1)::BIGINT] AS gt_shape,
         ['box', 'sphere', 'mesh', 'cylinder'][((clip + length(instance) + 2 + CASE WHEN (clip // 4) % 3 = 0 THEN 1 ELSE 0 END) % 4 + 1)::BIGINT] AS pred_shape
  FROM found),
edges AS (
  SELECT *, list_reverse_sort([size, 1, 2]::DOUBLE[]) AS gt_edges, list_reverse_sort([size, 1, size]::DOUBLE[]) AS pred_edges, CASE WHEN clip % 2 = 0 THEN [1, 0.5, 0.25]::DOUBLE[] END AS asset FROM paired),
agreed AS (
  SELECT *, list_avg([abs(gt_edges[i] / gt_edges[1] - pred_edges[i] / pred_edges[1]) FOR i IN range(1, 4)]) AS shape_error, pred_edges[1] / gt_edges[1] AS scale_ratio,
         list_avg([abs(gt_edges[i] / gt_edges[1] - asset[i]) FOR i IN range(1, 4)]) AS asset_error FROM edges)"""


def _agreed(spark, d) -> DataFrame:
    _, nodes_, _ = scenes(spark, d)
    nodes_ = stored(nodes_, "nodes")
    side = lambda s: nodes_.where(F.col("side") == s).select("clip", F.regexp_replace("node", "^p_", "").alias("k"), F.col("node").alias(f"{s}_node"))
    return S.agreement(side("gt").join(side("pred"), ["clip", "k"]).drop("k"), nodes_)


@query(f"""
WITH {PAIRED}
SELECT clip, count(*) AS matched, count(*) AS class_correct, round(avg((gt_motion = pred_motion)::INT), 6) AS motion_accuracy, round(avg((gt_shape = pred_shape)::INT), 6) AS shape_accuracy,
       round(quantile_cont(shape_error, 0.5), 6) AS shape_error, round(quantile_cont(scale_ratio, 0.5), 6) AS scale_ratio, round(quantile_cont(asset_error, 0.5), 6) AS asset_error,
       round(avg((shape_error <= 0.2::DOUBLE)::INT), 6) AS shape_ok, round(avg((scale_ratio BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE)::INT), 6) AS scale_ok
FROM agreed GROUP BY clip""")
def a1_scene_agreement(spark, d):
    """How pairs of the same name agree, clip by clip."""
    out = S.summarise(_agreed(spark, d))
    measured = ("motion_accuracy", "shape_accuracy", "shape_error", "scale_ratio", "asset_error", "shape_ok", "scale_ok")
    return out.select("clip", "matched", "class_correct", *[r6(F.col(c)).alias(c) for c in measured])


@query(f"""
WITH {PAIRED},
kinds AS (
  SELECT CASE WHEN instance IN ('error', 'signup') THEN 'static' ELSE 'object' END AS truth, CASE WHEN instance = 'error' OR instance = 'signup' AND clip % 5 <> 0 THEN 'static' ELSE 'object' END AS predicted FROM found)
SELECT 'motion' AS what, gt_motion AS truth, pred_motion AS predicted, count(*)::BIGINT AS n FROM agreed GROUP BY ALL
UNION ALL SELECT 'shape', gt_shape, pred_shape, count(*) FROM agreed GROUP BY ALL UNION ALL SELECT 'kind', truth, predicted, count(*) FROM kinds GROUP BY ALL""")
def a1_scene_confusions(spark, d):
    """Motion types, drawn shapes and kinds of pairs of the same name over all clips."""
    both, _, _ = scenes(spark, d)
    kinds = stored(both.select("side", "clip", "kind", F.regexp_replace("instance", "^p_", "").alias("k")).distinct(), "kinds")
    side = lambda s, name: kinds.where(F.col("side") == s).select("clip", "k", F.col("kind").alias(name))
    out = S.confusions(_agreed(spark, d), side("gt", "truth").join(side("pred", "predicted"), ["clip", "k"]))
    return out.groupBy("what", "truth", "predicted").agg(F.sum("n").alias("n"))


@query(None)
def a1_scene_evaluation(spark, d):
    """Every clip under a gauge with scale: what the scene got right, and where the scale is from."""
    both, nodes_, cameras = scenes(spark, d)
    found = S.evaluate_scenes(stored(both, "states"), nodes_, cameras, S.SceneParams(max_dist=5.0, gauge="similarity"))
    gauges = found.gauges.select("clip", r6(F.col("scale")).alias("scale"), "used", "why", "inliers")
    rates = ("recall", "precision", "class_accuracy", "motion_accuracy", "shape_accuracy", "shape_error", "scale_ratio", "asset_error", "scene_recall", "scene_precision")
    counts = ("n_gt", "n_pred", "matched", "matched_at_start", "only_at_start", "scene_gt", "scene_pred", "scene_matched")
    out = found.status.select("clip", "status").join(found.clips, "clip", "left").join(gauges, "clip", "left")
    return out.select("clip", "status", "scale", "used", "why", "inliers", *counts, *[r6(F.col(c)).alias(c) for c in rates])

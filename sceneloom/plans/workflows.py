"""The three workloads end to end: evaluation table, gated scene nodes, asset retrieval with its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.columns import r6
from sceneloom.operators import evaluation as E
from sceneloom.operators import matching as M
from sceneloom.operators import quality_rules as Q
from sceneloom.operators import retrieval as R
from sceneloom.operators import rules, scene, series
from sceneloom.operators import scene_evaluation as S
from sceneloom.plans.adapters import nodes, states, table
from sceneloom.plans.registry import query
from sceneloom.plans.scene_eval_queries import scenes
from sceneloom.shared import stored


def evaluate_states(truth: DataFrame, predicted: DataFrame, run: str, instance: str, config: DataFrame, limit: float, samples: int = 120, frac: float = 0.2, cover: float = 0.9, gauge: float | None = None) -> DataFrame:
    """W1 for tracks in the plane: per config and window (fit, full, holdout) the recall, precision and errors of matched tracks.

    ``truth`` and ``predicted`` are ``(run, instance, t, x, y)``; ``config(run, config)``. ``gauge``, if given, is the inlier limit of a rigid gauge. A
    pair counts in a window if both tracks support ``cover`` of it. Tracks with faults or of a single sample are left out.
    """
    keys = ["side", run, instance]
    sides = truth.withColumn("side", F.lit("gt")).unionByName(predicted.withColumn("side", F.lit("pred"))).select(*keys, "t", "x", "y")
    good = series.build_tracks(sides, keys).where("reason IS NULL AND samples >= 2").select(*keys)
    rows = sides.join(good, keys, "left_semi").select("side", F.col(run).alias("clip"), F.lit("object").alias("kind"), F.col(instance).alias("instance"), F.col(instance).alias("node"),
                                                      "t", "x", F.lit(0.0).alias("y"), F.col("y").alias("z"))
    rows = stored(rows, "states")
    none = lambda kind: F.lit(None).cast(kind)
    nodes_ = rows.select("side", "clip", "node").distinct().select(
        "*", none("string").alias("class"), none("string").alias("motion"), none("string").alias("shape"), none("array<double>").alias("extent"), none("array<double>").alias("asset_ratios"))
    p = S.SceneParams(samples=samples, holdout=frac, max_dist=limit, coverage=cover, gauge="none" if gauge is None else "rigid", gauge_dist=gauge)
    return evaluation_table(S.evaluate_scenes(rows, nodes_, p=p), config.select(F.col(run).alias("clip"), "config"))


def evaluation_table(found: S.SceneTables, config: DataFrame) -> DataFrame:
    """One row per config and window: what was matched and measured, and how well the pairs agree. Medians are over all pairs, shares over clips."""
    clips = found.clips.select("clip", "n_pred", "matched", "motion_accuracy", "shape_accuracy", "class_accuracy", "scene_recall", "scene_precision")
    per = found.windows.join(clips.withColumnRenamed("matched", "paired"), "clip").join(config.select("clip", "config"), "clip")
    per = per.withColumn("recall", F.col("n") / F.col("n_gt")).withColumn("precision", F.when(F.col("n_pred") > 0, F.col("n") / F.col("n_pred")))
    errors = found.pairs.where("distance IS NOT NULL").join(config.select("clip", "config"), "clip").withColumn("distance", F.round("distance", 9))
    median = E.weighted_median(errors, ["config", "window"], "distance", "median_error")
    mean = [F.avg(c).alias(c) for c in ("recall", "precision", "motion_accuracy", "shape_accuracy", "class_accuracy", "scene_recall", "scene_precision")]
    out = per.groupBy("config", "window").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("n_gt").alias("objects"), F.sum("paired").alias("paired"), F.sum("n").alias("matched"), F.count_if(F.col("state") == "complete").alias("complete"), *mean)
    return out.join(median, ["config", "window"], "left")


@query(None)
def w1_evaluation_table(spark, d):
    """Scenes of all clips under a rigid gauge, 120 samples a track and window, pooled by config."""
    both, nodes_, cameras = scenes(spark, d)
    both = stored(both, "states")
    config = both.select("clip").distinct().withColumn("config", F.concat(F.lit("cfg"), F.expr("cast(clip % 4 AS string)")))
    out = evaluation_table(S.evaluate_scenes(both, nodes_, cameras, S.SceneParams(max_dist=5.0, gauge_dist=2.0)), config)
    rounded = ("recall", "precision", "median_error", "motion_accuracy", "shape_accuracy", "class_accuracy", "scene_recall", "scene_precision")
    return out.select("config", "window", "runs", "objects", "paired", "matched", "complete", *[r6(F.col(c)).alias(c) for c in rounded])


def gated_nodes(det: DataFrame, frames: DataFrame, thresholds: DataFrame, boxes: list[Column]) -> tuple[DataFrame, DataFrame]:
    """W2: detections to tracks, their quality, the decision of each clip, and the nodes of clips that are not blocked.

    ``det(clip, detection_id, frame, label, score, x1.., t, visible, depth, width, height)``, ``frames(clip, frame, t)`` is the registry; ``boxes`` give
    ``px.., ex..`` of an observation. A clip is blocked by an error in the structure of its evidence (a box outside its image, a frame that is not
    registered or has another time, an object twice in a frame).
    """
    tracks = M.associate(det.select("clip", "detection_id", "frame", "label", "score", "x1", "y1", "x2", "y2"))
    tracks = stored(tracks.select("clip", "detection_id", F.col("track_id").alias("object_id"), "identity"), "tracks")
    obs = stored(det.join(tracks.drop("identity"), ["clip", "detection_id"]), "observations")
    seen = obs.withColumns({"bbox": F.lit(1), "mask": F.lit(1)})
    none = F.lit(None).cast("double")
    boxed = seen.select("clip", "object_id", F.col("frame").alias("frame_index"), "t", "x1", "y1", "x2", "y2", "width", "height", none.alias("d_min"), F.col("depth").alias("d_median"), none.alias("d_max"))
    structure = rules.validate_evidence(boxed, frames.select("clip", F.col("frame").alias("frame_index"), "t"))
    structure = stored(structure.where("severity = 'error'"), "structure")
    attributes = obs.select("clip", "object_id", F.lit("geometry").alias("name"), F.when(F.col("depth").isNotNull(), F.col("score")).alias("confidence"))
    candidates = tracks.where("size(identity) > 0").select("clip", "object_id", F.col("detection_id").alias("hypothesis"), F.explode("identity").alias("i"))
    candidates = candidates.select("clip", "object_id", "hypothesis", "i.confidence")
    support = obs.groupBy("clip", "object_id").agg(F.avg("score").alias("motion_support"))
    objects = stored(Q.evidence_metrics(seen, frames, attributes, candidates, support), "objects")
    clips = frames.select("clip").distinct().withColumn("scale_factor", F.lit(1.0))
    _, decided = Q.assess(objects, Q.camera_metrics(frames.select("clip", "t"), frames), clips, thresholds, structure)
    decided = stored(decided, "decisions")
    node = obs.select("clip", F.col("object_id").alias("node_id"), "t", *boxes, F.lit(False).alias("s"))
    kept = scene.evidence_to_nodes(node, ["clip", "node_id"], "t", F.col("s")).join(decided.where("decision <> 'block'").select("clip", "decision"), "clip")
    return decided, kept


@query(None)
def w2_quality_gated_nodes(spark, d):
    """Detections of event frames to tracks, the rule-table gate, and the nodes of clips that are not blocked, validated with their supports."""
    s = states(spark, d)
    det = s.select("clip", F.col("event_id").alias("detection_id"), F.floor(F.col("t") / 3600).cast("int").alias("frame"), F.col("instance").alias("label"), (F.col("x") / 100).alias("score"),
                   F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 30).alias("x2"), (F.col("y") + 40).alias("y2"), "t")
    kept = M.nms(det, ["clip", "frame"], 40_000.0, 0.7).select("clip", "detection_id")
    det = stored(det.join(kept, ["clip", "detection_id"], "left_semi"), "detections")
    frames = stored(det.groupBy("clip", "frame").agg(F.min("t").alias("t")), "frames")
    # Times of a frame are the registry's; boxes lie in images of 280 by 145, so some reach outside.
    det = det.drop("t").join(frames, ["clip", "frame"]).select(
        "*", (F.col("x1") / 100).alias("visible"), F.when(F.col("y1") >= 20, F.col("y1")).alias("depth"), F.lit(280.0).alias("width"), F.lit(145.0).alias("height"))
    boxes = [F.col("x1").alias("px"), F.lit(0.5).alias("py"), F.col("y1").alias("pz"), F.lit(0.3).alias("ex"), F.lit(1.0).alias("ey"), F.lit(0.4).alias("ez")]
    decided, n = gated_nodes(det, frames, Q.thresholds(spark, {"default": Q.DEFAULTS}), boxes)
    n = stored(n, "nodes")
    # Each node rests on the one with the least id of its clip; that one rests on none.
    first = n.groupBy("clip").agg(F.min("node_id").alias("target"))
    refs = n.join(first, "clip").where("node_id <> target").select("clip", "node_id", "target")
    found = rules.validate_nodes(n, refs).groupBy("clip").agg(F.count(F.lit(1)).alias("findings"))
    counts = n.groupBy("clip").agg(F.count(F.lit(1)).alias("nodes"), F.sum("frames").alias("observations")).join(found, "clip", "left")
    return decided.select("clip", "decision", "diagnostics").join(counts, "clip", "left").na.fill(0, ["nodes", "observations", "findings"])


@query(None)
def w3_retrieval_audit(spark, d):
    """Distinct labels retrieve assets by text, the shortlist is reordered, the choice is gated and audited against same-kit truths."""
    assets = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kit"), F.col("p_type").alias("kit_title"))
    objects = nodes(spark, d, F.col("l_partkey").alias("asset_id")).where("grp = 'object'").select("clip", "node", "asset_id").join(assets.select("asset_id", F.col("name").alias("query")), "asset_id").drop("asset_id")
    scores = stored(R.top_assets(objects, assets, 24), "scores")
    images = scores.select("query", "asset_id", F.expr("((asset_id * 7 + length(query)) % 11) / 11D").alias("image"))
    chosen = R.choose_assets(R.retrieve(scores, images, 5))
    named = chosen.join(assets.select(F.col("asset_id").cast("string").alias("chosen"), F.col("name").alias("found")), "chosen", "left")
    return objects.groupBy("query").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("clip").alias("clips")).join(named, "query", "left").select(
        "query", "objects", "clips", "chosen", "score", "reason", (F.col("found") == F.col("query")).alias("same_name")
    )

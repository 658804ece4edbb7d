"""The evidence gate as a rule table: metrics as rows, thresholds as rows, a range join that yields diagnostics, and a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneloom.operators import evaluation as E
from sceneloom.shared import with_lookup

#: Threshold, scope, metric, side on which the metric fails, code of the diagnostic.
RULES = (
    ("min_camera_frame_coverage", "camera", "frame_coverage", "<", "low_camera_frame_coverage"),
    ("min_camera_temporal_span_ratio", "camera", "span_ratio", "<", "short_camera_span"),
    ("min_object_observation_coverage", "object", "coverage", "<", "low_object_coverage"),
    ("min_bbox_coverage", "object", "bbox_measured", "<", "low_bbox_coverage"),
    ("min_mask_coverage", "object", "mask_measured", "<", "low_mask_ref_coverage"),
    ("min_depth_coverage", "object", "depth_measured", "<", "low_depth_coverage"),
    ("min_visibility_coverage", "object", "visible_measured", "<", "low_visible_fraction_coverage"),
    ("max_track_gap_frames", "object", "max_gap", ">", "track_break"),
    ("min_object_temporal_span_ratio", "object", "span_ratio", "<", "short_track_span"),
    ("max_attribute_unknown_ratio", "object", "attribute_unknown_ratio", ">", "high_attribute_unknown_ratio"),
    ("max_identity_ambiguity", "object", "identity_entropy", ">", "high_identity_ambiguity"),
    ("min_motion_support", "object", "motion_support", "<", "low_motion_support"),
    ("max_severe_occlusion_fraction", "object", "severe_occlusion", ">", "severe_occlusion"),
)
#: The default thresholds.
DEFAULTS = {
    "min_object_observation_coverage": 0.20, "min_bbox_coverage": 0.70, "min_mask_coverage": 0.70, "min_depth_coverage": 0.50, "min_visibility_coverage": 0.25, "max_track_gap_frames": 3,
    "min_object_temporal_span_ratio": 0.20, "min_camera_frame_coverage": 0.50, "min_camera_temporal_span_ratio": 0.70, "max_attribute_unknown_ratio": 0.50, "max_identity_ambiguity": 0.80,
    "min_motion_support": 0.40, "severe_occlusion_visible_fraction": 0.20, "max_severe_occlusion_fraction": 0.50,
}
#: The calibration factor above which a world's ground plane is taken for wrong.
DEGENERATE_SCALE = 8.0
DIAGNOSTIC = "config string, clip long, path string, code string, severity string, value double, bound double"


def thresholds(spark: SparkSession, configs: dict[str, dict[str, float]]) -> DataFrame:
    """``config, key, value`` rows of named sets of thresholds."""
    return spark.createDataFrame([(c, k, float(v)) for c, values in configs.items() for k, v in values.items()], "config string, key string, value double")


def rule_table(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules ``config, scope, metric, side, code, bound`` of valid thresholds, and what is wrong with the others (``config, key, code``).

    Ratios lie in [0, 1]; the gap is a whole number of at least 0. Missing or invalid ones leave their check out and are told.
    """
    spark = given.sparkSession
    known = spark.createDataFrame([(r[0], r) for r in RULES] + [("severe_occlusion_visible_fraction", None)], "key string, rule struct<key:string,scope:string,metric:string,side:string,code:string>")
    j = given.select("config").distinct().join(F.broadcast(known)).join(given, ["config", "key"], "left")
    number = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    whole = F.when(F.col("key") == "max_track_gap_frames", (F.col("value") >= 0) & (F.col("value") == F.floor("value"))).otherwise(F.col("value").between(0, 1))
    valid = number & whole
    rules = j.where(valid & F.col("rule").isNotNull()).select("config", "rule.scope", "rule.metric", "rule.side", "rule.code", F.col("value").alias("bound"))
    wrong = j.where(~F.coalesce(valid, F.lit(False))).select("config", "key", F.when(F.col("value").isNull(), "quality_thresholds_incomplete").otherwise("invalid_quality_threshold").alias("code"))
    return rules, wrong


def evidence_metrics(observations: DataFrame, frames: DataFrame, attributes: DataFrame, candidates: DataFrame, support: DataFrame, severe: float = 0.2) -> DataFrame:
    """All metrics of each object. Unknown is null and never imputed.

    ``observations(clip, object_id, frame, t, bbox, mask, depth, visible)`` (``bbox`` and ``mask`` are null where unknown), ``frames(clip, frame, t)``,
    ``attributes(clip, object_id, name, confidence)``, ``candidates(clip, object_id, hypothesis, confidence)`` of identity,
    ``support(clip, object_id, motion_support)``.
    """
    keys = ["clip", "object_id"]
    known = lambda c: F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_measured")
    seen = F.count_if(F.col("visible") <= severe) / F.count("visible")
    extra = observations.groupBy(*keys).agg(known("bbox"), known("mask"), known("visible"), F.when(F.count("visible") > 0, seen).alias("severe_occlusion"))
    unknown = attributes.groupBy(*keys).agg(F.avg(F.col("confidence").isNull().cast("double")).alias("attribute_unknown_ratio"))
    entropy = E.identity_entropy(candidates, keys, "hypothesis", "confidence").select(*keys, F.col("entropy").alias("identity_entropy"), F.lit(True).alias("has_hypotheses"))
    base = E.quality_metrics(observations.select(*keys, "frame", "t", "visible", "depth"), frames, severe).drop("severe_occlusion")
    out = base.join(extra, keys).join(unknown, keys, "left").join(entropy, keys, "left").join(support, keys, "left")
    return out.na.fill(0.0, ["attribute_unknown_ratio"]).na.fill(False, ["has_hypotheses"])


def camera_metrics(poses: DataFrame, frames: DataFrame) -> DataFrame:
    """``clip, poses, frame_coverage, span_ratio`` of ``poses(clip, t)`` against the registered ``frames(clip, frame, t)``; a clip without poses has none."""
    clips = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("__n"), (F.max("t") - F.min("t")).alias("__d"))
    seen = poses.groupBy("clip").agg(F.count(F.lit(1)).alias("poses"), (F.max("t") - F.min("t")).alias("__s"))
    j = clips.join(seen, "clip", "left").na.fill(0, ["poses"]).na.fill(0.0, ["__s"])
    cover = F.least(F.col("poses") / F.col("__n"), F.lit(1.0))
    return j.select("clip", "poses", cover.alias("frame_coverage"), F.when(F.col("__d") > 0, F.least(F.col("__s") / F.col("__d"), F.lit(1.0))).otherwise(0.0).alias("span_ratio"))


def association_metrics(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``clip, tracks, with_hypotheses, codes``: tracks, those with identity hypotheses, and how often each code of ``diagnostics(clip, code)`` came up."""
    tracks = objects.groupBy("clip").agg(F.count(F.lit(1)).alias("tracks"), F.count_if("has_hypotheses").alias("with_hypotheses"))
    codes = diagnostics.groupBy("clip", F.coalesce("code", F.lit("unknown")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    codes = codes.groupBy("clip").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", F.col("n").cast("string")))), ",").alias("codes"))
    return tracks.join(codes, "clip", "full").na.fill(0, ["tracks", "with_hypotheses"]).na.fill("", ["codes"])


def unpivoted(rows: DataFrame, scope: str, path: Column, metrics: list[str]) -> DataFrame:
    """``clip, scope, path, metric, value``: a row for each metric."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select("clip", F.lit(scope).alias("scope"), path.cast("string").alias("path"), F.explode(values).alias("m")).select("clip", "scope", "path", "m.*")


def diagnose(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Diagnostics of metrics on the wrong side of their bound, for each config's rules; unknown metrics break no rule."""
    j = with_lookup(metrics.where("value IS NOT NULL"), rules, ["scope", "metric"], "inner")
    beyond = F.when(F.col("side") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return j.where(beyond).select("config", "clip", F.concat_ws("/", "scope", "path", "metric").alias("path"), "code", F.lit("warning").alias("severity"), "value", "bound")


def assess(objects: DataFrame, cameras: DataFrame, clips: DataFrame, given: DataFrame, structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagnostics (``config, clip, path, code, severity, value, bound``) and decisions (``config, clip, decision, diagnostics``) of every clip and config.

    ``clips(clip, scale_factor)`` are all clips; ``structure(clip, severity, code, path)`` is what validation found. A structural error blocks, and
    nothing else is said of that clip; any warning warns, also one about the thresholds; else the clip proceeds.
    """
    rules, wrong = rule_table(given)
    blocked = structure.where("severity = 'error'").select("clip").distinct()
    rest = clips.join(blocked, "clip", "left_anti")
    metrics = unpivoted(objects, "object", F.col("object_id"), [r[2] for r in RULES if r[1] == "object"])
    metrics = metrics.unionByName(unpivoted(cameras, "camera", F.lit("camera"), [r[2] for r in RULES if r[1] == "camera"])).join(rest.select("clip"), "clip", "left_semi")
    fixed = objects.join(rest.select("clip"), "clip", "left_semi")
    tell = lambda rows, path, code, value=F.lit(None), bound=F.lit(None): rows.select(
        "clip", path.cast("string").alias("path"), F.lit(code).alias("code"), F.lit("warning").alias("severity"), value.cast("double").alias("value"), bound.cast("double").alias("bound"))
    every = tell(fixed.where("identity_entropy IS NULL AND has_hypotheses"), F.concat_ws("/", F.lit("object"), "object_id", F.lit("identity_entropy")), "identity_ambiguity_unknown")
    every = every.unionByName(tell(fixed.where("motion_support IS NULL"), F.concat_ws("/", F.lit("object"), "object_id", F.lit("motion_support")), "motion_support_unknown"))
    every = every.unionByName(tell(rest.join(objects.select("clip").distinct(), "clip", "left_anti"), F.lit("objects"), "no_evidence_objects"))
    every = every.unionByName(tell(rest.where(F.col("scale_factor") > DEGENERATE_SCALE), F.lit("alignment/scale_factor"), "world_alignment_degenerate", F.col("scale_factor"), F.lit(DEGENERATE_SCALE)))
    found = structure.select("clip", F.col("path").cast("string").alias("path"), "code", "severity", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("bound"))
    configs = given.select("config").distinct()
    shared = F.broadcast(configs)  # a handful of named configurations
    said = diagnose(metrics, rules).unionByName(every.unionByName(found).crossJoin(shared).select("config", "clip", "path", "code", "severity", "value", "bound"))
    about = wrong.groupBy("config").agg(F.count(F.lit(1)).alias("wrong"))
    counts = said.groupBy("config", "clip").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    j = clips.select("clip").crossJoin(shared).join(counts, ["config", "clip"], "left").join(F.broadcast(about), "config", "left").na.fill(0, ["n", "errors", "warnings", "wrong"])
    decision = F.when(F.col("errors") > 0, "block").when(F.col("warnings") + F.col("wrong") > 0, "warn").otherwise("proceed")
    return said, j.select("config", "clip", decision.alias("decision"), F.col("n").alias("diagnostics"))


def worst_first(diagnostics: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent codes of each config, ties by code."""
    n = diagnostics.groupBy("config", "code", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("clip").alias("clips"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("config").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= k)

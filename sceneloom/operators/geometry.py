"""Grouped geometry, motion and colour over points, pixels and tracks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.columns import upper_median
from sceneloom.operators.grouped import map_groups
from sceneloom.shared import with_lookup


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def unproject(pixels: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """World points of pixels with depth: ``pixels(keys, u, v, depth)``, ``cameras(keys, fx, fy, cx, cy, yaw, tx, ty, tz)``.

    Depths of 1e-4 or less are invalid; the image's y and z axes are turned over before the camera's yaw and place.
    """
    j = with_lookup(pixels.where("depth > 1e-4"), cameras, keys, "inner")
    x, y, z = (F.col("u") - F.col("cx")) / F.col("fx") * F.col("depth"), -(F.col("v") - F.col("cy")) / F.col("fy") * F.col("depth"), -F.col("depth")
    c, s = F.cos("yaw"), F.sin("yaw")
    return j.select(*keys, "u", "v", (c * x + s * z + F.col("tx")).alias("x"), (y + F.col("ty")).alias("y"), (-s * x + c * z + F.col("tz")).alias("z"))


def oriented_boxes(points: DataFrame, keys: list[str], least: int = 20, cut: float = 0.03) -> DataFrame:
    """Boxes turned to the main horizontal axis: trimmed at 1.5 times the 90th percentile of distance to the median, bounds at 3 and 97 %.

    Three aggregations over the same partitioning; no group is gathered.
    """
    mid = points.groupBy(*keys).agg(*[median(c).alias(f"m{c}") for c in "xyz"], F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    far = points.join(mid, keys).withColumn("__d", F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "xyz"), F.lit(0.0))))
    limit = far.groupBy(*keys).agg((F.percentile("__d", F.lit(0.9)) * 1.5 + 1e-6).alias("__limit"))
    kept = far.join(limit, keys).where(F.col("__d") < F.col("__limit")).select(*keys, "x", "y", "z")
    shape = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.avg("x").alias("cx"), F.avg("z").alias("cz"), F.covar_samp("x", "z").alias("sxz"), F.var_samp("x").alias("sx"), F.var_samp("z").alias("sz"))
    shape = shape.where(F.col("points") >= least).withColumn("yaw", 0.5 * F.atan2(2 * F.col("sxz"), F.col("sx") - F.col("sz")))
    local = kept.join(shape, keys).withColumn("a", F.cos("yaw") * (F.col("x") - F.col("cx")) + F.sin("yaw") * (F.col("z") - F.col("cz"))).withColumn("b", -F.sin("yaw") * (F.col("x") - F.col("cx")) + F.cos("yaw") * (F.col("z") - F.col("cz")))
    both = F.array(F.lit(cut), F.lit(1 - cut))
    out = local.groupBy(*keys, "points", "cx", "cz", "yaw").agg(*[F.percentile(c, both).alias(f"p{c}") for c in ("a", "y", "b")])
    size = lambda c: F.greatest(F.col(f"p{c}")[1] - F.col(f"p{c}")[0], F.lit(0.02))
    centre = lambda c: (F.col(f"p{c}")[0] + F.col(f"p{c}")[1]) / 2
    return out.select(
        *keys, "points", "yaw", (F.col("cx") + F.cos("yaw") * centre("a") - F.sin("yaw") * centre("b")).alias("px"), centre("y").alias("py"),
        (F.col("cz") + F.sin("yaw") * centre("a") + F.cos("yaw") * centre("b")).alias("pz"), size("a").alias("ex"), size("y").alias("ey"), size("b").alias("ez"),
    )


def plane_candidates(points: DataFrame, clip: str, threshold: float = 0.05, planes: int = 4, tries: int = 100, least: int = 30) -> DataFrame:
    """Up to four planes per clip by seeded sampling consensus; a helper on a clip's (strided) ground points."""
    def fit(key, left):
        rng = np.random.default_rng(7)
        for idx in range(planes):
            if len(left) < least:
                return
            best = None
            for _ in range(tries):
                a, b, c = left[rng.choice(len(left), 3, replace=False)]
                normal = np.cross(b - a, c - a)
                size = np.linalg.norm(normal)
                if size < 1e-9:
                    continue
                inside = np.abs((left - a) @ (normal / size)) < threshold
                if best is None or inside.sum() > best.sum():
                    best = inside
            if best is None or best.sum() < least // 2:
                return
            centre = left[best].mean(0)
            normal = np.linalg.svd(left[best] - centre, full_matrices=False)[2][-1]
            normal = normal if normal[1] >= 0 else -normal
            inside = np.abs((left - centre) @ normal) < threshold
            yield idx, int(inside.sum()), float(np.degrees(np.arccos(np.clip(normal[1], -1, 1)))), float(-normal @ centre), [float(x) for x in normal]
            left = left[~inside]

    return map_groups(points, [clip], ["x", "y", "z"], fit, "idx int, inliers int, angle_deg double, offset double, normal array<double>", numbers=True)


def choose_ground(candidates: DataFrame, clip: str, min_ratio: float = 0.25, prior: float = 1.2) -> DataFrame:
    """The clip's ground among ``(clip, idx, inliers, angle_deg, angle_to_view_deg, cam_height, frac_obj_above)``.

    Upright planes below the camera and most objects; without one, planes that face the camera. Those that lie on the camera
    (under a quarter of the median camera height) go, unless all would. The score is inliers weighted by objects above; the scale
    brings the camera to its prior height.
    """
    upright = (F.col("angle_deg") < 50) & (F.col("cam_height") > 0) & (F.col("frac_obj_above") >= 0.5)
    facing = (F.col("angle_to_view_deg") < 35) & (F.col("frac_obj_above") >= 0.3)
    by = Window.partitionBy(clip)
    rows = candidates.withColumn("__u", F.max(upright).over(by)).withColumn("__ok", F.when(F.col("__u"), upright).otherwise(facing)).where("__ok")
    rows = rows.withColumn("cam_height", F.when(F.col("__u"), F.col("cam_height")).otherwise(F.abs("cam_height")))
    mid = rows.groupBy(clip).agg(median("cam_height").alias("__m"))
    rows = rows.join(mid, clip).withColumn("__far", F.col("cam_height") >= min_ratio * F.col("__m"))
    rows = rows.withColumn("__any", F.max("__far").over(by)).where("__far OR NOT __any").withColumn("score", F.col("inliers") * (0.5 + 0.5 * F.col("frac_obj_above")))
    best = rows.withColumn("__r", F.row_number().over(by.orderBy(F.desc("score"), "idx"))).where("__r = 1")
    return best.select(clip, "idx", "score", F.when(F.col("__u"), "upright").otherwise("facing_camera").alias("mode"), F.when(F.col("cam_height") > 1e-3, F.lit(prior) / F.col("cam_height")).otherwise(1.0).alias("scale"))


def hinge_pivot(axis: list[Column], angle: Column, moved: list[Column], anchor: list[Column]) -> list[Column]:
    """Point of a hinge's line that is nearest to ``anchor``, from the unit axis, the angle turned (radians) and the translation of the whole motion.

    Null if nothing turned. It solves p = R p + t by least squares: across the axis p is half of t plus half the cotangent of half the angle times axis x t.
    """
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    across = [t - u * dot(axis, moved) for t, u in zip(moved, axis)]
    ux, uy, uz = axis
    tx, ty, tz = across
    side = [uy * tz - uz * ty, uz * tx - ux * tz, ux * ty - uy * tx]
    half = F.tan(angle / 2)
    p = [(t + s / F.when(half != 0, half)) / 2 for t, s in zip(across, side)]
    along = dot(axis, [a - b for a, b in zip(anchor, p)])
    return [x + u * along for x, u in zip(p, axis)]


def _total(c: str) -> Column:
    """The sum of a column's values as decimals of 15 places, which no order of the rows changes; a plain sum where a value has over 13 digits before the point."""
    exact = F.expr(f"try_cast(`{c}` AS decimal(28, 15))")
    return F.when(F.count(exact) == F.count(c), F.sum(exact).cast("double")).otherwise(F.sum(c))


def infer_articulation(steps: DataFrame, keys: list[str]) -> DataFrame:
    """From per-step motions ``(keys, step_m, step_deg, axis_x.., travel_m, diag)``: static, hinge, slide or none.

    Static if the median step is at most 2 % of the diagonal and 1.5 degrees; a hinge if it turned 8 degrees about a steady
    axis (0.85); a slide if it went 5 cm nearly straight (0.9). Totals are added as decimals, so steps of exactly 8 degrees in all are a
    hinge in whatever order they come.
    """
    unit = lambda c: F.col(c) / F.greatest(F.sqrt(F.expr("axis_x * axis_x + axis_y * axis_y + axis_z * axis_z")), F.lit(1e-12))
    m = steps.groupBy(*keys).agg(
        median(F.col("step_m") / F.col("diag")).alias("rel"), median("step_deg").alias("deg"), _total("step_deg").alias("turned"), _total("step_m").alias("path"), F.max("travel_m").alias("travel"),
        *[F.avg(unit(f"axis_{c}")).alias(f"a{c}") for c in "xyz"],
    )
    steady = F.sqrt(F.expr("ax * ax + ay * ay + az * az"))
    straight = F.col("travel") / F.greatest(F.col("path"), F.lit(1e-9))
    kind = F.when((F.col("rel") <= 0.02) & (F.col("deg") <= 1.5), "static").when((F.col("turned") >= 8) & (steady >= 0.85), "hinge").when((F.col("travel") >= 0.05) & (straight >= 0.9), "slide").otherwise("none")
    return m.select(*keys, kind.alias("joint"), steady.alias("axis_consistency"), straight.alias("straightness"))


def fit_shape_kind(points: DataFrame, keys: list[str], least: int = 40) -> DataFrame:
    """Box, sphere, cylinder or cone whose surface is nearest to held-out points: fitted on one half, judged on the other."""
    def fit(_, p):
        if len(p) < least:
            return
        p = (p - np.median(p, 0)) / max(float(np.ptp(p, 0).max()), 1e-9)
        far = np.linalg.norm(p, axis=1)
        p = p[far <= np.quantile(far, 0.95)]
        a, b = p[::2], p[1::2]
        centre, half = (a.max(0) + a.min(0)) / 2, np.ptp(a, 0) / 2
        q = b - centre
        out = {"box": np.abs(np.max(np.abs(q) - half, axis=1)).mean()}
        out["sphere"] = np.abs(np.linalg.norm(q, axis=1) - np.linalg.norm(a - centre, axis=1).mean()).mean()
        radius = np.linalg.norm((a - centre)[:, [0, 2]], axis=1)
        flat = np.linalg.norm(q[:, [0, 2]], axis=1)
        out["cylinder"] = np.minimum(np.abs(flat - np.quantile(radius, 0.9)), np.abs(np.abs(q[:, 1]) - half[1])).mean()
        slope = np.clip((half[1] - q[:, 1]) / max(2 * half[1], 1e-9), 0, 1) * np.quantile(radius, 0.9)
        out["cone"] = np.minimum(np.abs(flat - slope), np.abs(q[:, 1] + half[1])).mean()
        best = min(sorted(out), key=out.get)
        yield best, float(out[best])

    return map_groups(points, keys, ["x", "y", "z"], fit, "kind string, residual double", numbers=True)


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of a group; the first by name of equals."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    return counts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), value))).where("__r = 1").drop("__r")


def metric_scale(objects: DataFrame, priors: DataFrame, clip: str, least: int = 2, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """Median of prior over observed size of a clip's known objects (anchors of half a metre or more preferred); 1 if absurd or too few.

    ``objects(clip, node, name, longest)``, ``priors(word, size)``; the longest prior word in the name counts. Names are distinct words of a
    bounded vocabulary, so the prior table is looked up once per name.
    """
    names = objects.select("name").distinct()
    words = names.withColumn("word", F.explode(F.split(F.lower("name"), "[^a-z0-9]+"))).join(priors, "word")
    best = words.withColumn("__r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.length("word")), "word"))).where("__r = 1").select("name", "size")
    j = objects.where("longest > 1e-6").join(best, "name").withColumn("ratio", F.col("size") / F.col("longest")).withColumn("anchor", F.col("size") >= 0.5)
    out = j.groupBy(clip).agg(F.count(F.lit(1)).alias("known"), F.count_if("anchor").alias("anchors"), median(F.when(F.col("anchor"), F.col("ratio"))).alias("__a"), median("ratio").alias("__m"))
    factor = F.when(F.col("anchors") >= least, F.col("__a")).otherwise(F.col("__m"))
    ok = (F.col("known") >= least) & factor.between(low, high)
    return out.select(clip, "known", "anchors", F.when(ok, factor).otherwise(1.0).alias("factor"))


def observed_colour(pixels: DataFrame, keys: list[str], frame: str, least: int = 4) -> DataFrame:
    """Median over frames of the medians of a mask's channels, and its hex code (half rounds up)."""
    per = pixels.groupBy(*keys, frame).agg(*[median(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    out = per.groupBy(*keys).agg(*[median(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("frames"))
    code = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.floor(F.col(c) + 0.5).cast("long"))), 2, "0") for c in "rgb"])
    return out.withColumn("hex", code)


def colour_residual(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute channel error and luma ratio of rendered against observed colours, the gain that would mend it."""
    luma = lambda p: 0.2126 * F.col(f"{p}r") + 0.7152 * F.col(f"{p}g") + 0.0722 * F.col(f"{p}b")
    ratio = luma("") / F.greatest(luma("o"), F.lit(1e-6))
    out = pairs.groupBy(*keys).agg(median((F.abs(F.col("r") - F.col("or")) + F.abs(F.col("g") - F.col("og")) + F.abs(F.col("b") - F.col("ob"))) / 3).alias("error"), median(ratio).alias("luma_ratio"))
    return out.withColumn("gain", F.least(F.greatest(1 + 0.5 * (1 / F.col("luma_ratio") - 1), F.lit(0.25)), F.lit(4.0)))


def light_factor(ratios: DataFrame, clip: str, ratio: str) -> DataFrame:
    """Lighting times the upper median of the needed factors, at most 1.5, only while the scene is too dark."""
    out = ratios.groupBy(clip).agg(F.array_sort(F.collect_list(1 / F.col(ratio))).alias("f"), upper_median(F.array_sort(F.collect_list(F.col(ratio)))).alias("mid"))
    return out.select(clip, F.when(F.col("mid") < 0.99, F.least(upper_median(F.col("f")), F.lit(1.5))).otherwise(1.0).alias("light"))


def mask_agreement(a: DataFrame, b: DataFrame, keys: list[str], diagonal: float) -> DataFrame:
    """IoU of two pixel sets and the shift of their centres over the image diagonal: one aggregation of a union, no join."""
    rows = a.select(*keys, "u", "v", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(*keys, "u", "v", F.lit(0).alias("a"), F.lit(1).alias("b")))
    px = rows.groupBy(*keys, "u", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    centre = lambda s, c: F.avg(F.when(F.col(s) == 1, F.col(c)))
    out = px.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.count(F.lit(1)).alias("either"), *[centre(s, c).alias(f"{s}{c}") for s in "ab" for c in "uv"])
    shift = F.hypot(F.col("au") - F.col("bu"), F.col("av") - F.col("bv")) / diagonal
    return out.select(*keys, (F.col("both") / F.col("either")).alias("iou"), shift.alias("shift"))


def pixel_coverage(pixels: DataFrame, clip: str, frame: str, area: float) -> DataFrame:
    """Part of each image that any mask covers: mean over frames, and the best frame."""
    per = pixels.select(clip, frame, "u", "v").distinct().groupBy(clip, frame).agg((F.count(F.lit(1)) / F.lit(area)).alias("c"))
    return per.groupBy(clip).agg(F.avg("c").alias("mean_coverage"), F.max("c").alias("best_coverage"), F.min_by(frame, F.struct(-F.col("c"), F.col(frame))).alias("best_frame"))

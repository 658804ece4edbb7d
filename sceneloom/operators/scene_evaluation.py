"""Evaluation of reconstructed scenes against their truth: one gauge, frozen identities, two windows, whole corpora of clips.

Tracks become arrays (a track is the frames of one clip). They are resampled on their clip's grid once; what is compared are rows of
fixed-size grids, so a pair of tracks is one row, however many samples are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.columns import scale_ratio, shape_error
from sceneloom.operators import matching as M
from sceneloom.operators import series
from sceneloom.shared import stored

AXES = ("x", "y", "z")
TRACK = ["side", "clip", "kind", "instance"]
SAMPLES = "array<struct<t:double,x:double,y:double,z:double>>"


@dataclass(frozen=True)
class SceneParams:
    """``gauge`` is ``none``, ``rigid`` (turn about the vertical and horizontal shift) or ``similarity`` (a scale too). ``match_on`` is ``mean``
    (over the fit window) or ``start`` (its first instant). ``gauge_dist`` is the inlier limit of the coarse gauge, ``max_dist`` unless given."""

    samples: int = 120
    holdout: float = 0.2
    max_dist: float = 3.0
    coverage: float = 0.9
    gauge: str = "rigid"
    match_on: str = "mean"
    gauge_dist: float | None = None
    camera_samples: int = 120
    still: float = 0.1

    def __post_init__(self):
        if self.gauge not in ("none", "rigid", "similarity") or self.match_on not in ("mean", "start"):
            raise ValueError("unknown gauge or criterion")
        if not 0 < self.holdout < 1 or self.samples < 2 or not 0 <= self.coverage <= 1 or not (math.isfinite(self.max_dist) and self.max_dist >= 0):
            raise ValueError("invalid parameters of the evaluation")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and flat fields of a column of sample lists."""
    flat = column.flatten()
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    return offsets, {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("t", *AXES)}


def _interpolated(field: dict[str, np.ndarray], a: int, b: int, times: np.ndarray) -> np.ndarray:
    """The three axes of a track at the times, nothing outside its own samples."""
    t = field["t"][a:b]
    if not len(t):
        return np.full((3, len(times)), np.nan)
    out = np.stack([np.interp(times, t, field[c][a:b]) for c in AXES])
    out[:, (times < t[0]) | (times > t[-1])] = np.nan
    return out


def resample_on_grid(tracks: DataFrame, n: int) -> DataFrame:
    """Add ``grid`` (x, then y, then z at ``n`` even times from ``begin`` to ``end``; NaN where not supported) and the mean ``cx, cy, cz``.

    The mean is over the supported times, or over the samples if none is. ``samples`` may be empty.
    """
    keep = [c for c in tracks.columns if c not in ("samples", "begin", "end")]
    types = ", ".join(f"`{c}` {tracks.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, field = _lists(batch.column("samples"))
            begin, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "end"))
            grids = np.empty((batch.num_rows, 3, n))
            means = np.full((batch.num_rows, 3), np.nan)
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                grids[i] = _interpolated(field, a, b, np.linspace(begin[i], end[i], n))
                good = ~np.isnan(grids[i, 0])
                if good.any():
                    means[i] = grids[i][:, good].mean(axis=1)
                elif b > a:
                    means[i] = [field[c][a:b].mean() for c in AXES]
            whole = pa.ListArray.from_arrays(pa.array(np.arange(0, grids.size + 1, 3 * n), pa.int32()), pa.array(grids.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), whole, *(pa.array(m) for m in means.T)], names=[*keep, "grid", "cx", "cy", "cz"])

    return tracks.select(*keep, "samples", "begin", "end").mapInArrow(run, f"{types}, grid array<double>, cx double, cy double, cz double")


def rms_radius(*axes: str) -> Column:
    """Root of the mean squared distance of points from their mean; 0 for fewer than two."""
    return F.when(F.count(axes[0]) >= 2, F.sqrt(sum((F.var_pop(a) for a in axes[1:]), F.var_pop(axes[0])))).otherwise(0.0)


def camera_scale(cameras: DataFrame, spans: DataFrame, spread: DataFrame, n: int = 120, still: float = 0.1) -> DataFrame:
    """Scale from predicted to true lengths by the cameras' RMS radius: ``clip, scale, used, why, gt_radius, pred_radius``.

    Each clip has one camera a side, so no detection can spoil it. ``cameras(side, clip, t, x, y, z)`` count from ``begin`` to ``end`` of
    ``spans(clip, begin, end)`` and are compared at the same ``n`` times of what both support. The scale is 1 and ``used`` is ``none`` where
    it can't be told; ``why`` is ``too_few``, ``repeated_time``, ``no_common_span``, ``still_camera`` (a radius below ``still`` of the
    ``spread(clip, gt_spread, pred_spread)`` of the objects) or ``degenerate``.
    """
    finite = F.lit(True)
    for c in ("t", *AXES):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    rows = cameras.where(finite).join(spans, "clip").where("t BETWEEN begin AND end").select("side", "clip", "t", *AXES)
    sides = rows.groupBy("side", "clip").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("t").alias("times"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    one = lambda s: sides.where(F.col("side") == s).select("clip", *[F.col(c).alias(f"{s}_{c}") for c in ("frames", "times", "lo", "hi")])
    both = spans.select("clip").join(one("gt"), "clip", "left").join(one("pred"), "clip", "left")
    both = both.withColumns({"lo": F.greatest("gt_lo", "pred_lo"), "hi": F.least("gt_hi", "pred_hi")})
    few = (F.coalesce("gt_frames", F.lit(0)) < 2) | (F.coalesce("pred_frames", F.lit(0)) < 2)
    again = (F.col("gt_times") < F.col("gt_frames")) | (F.col("pred_times") < F.col("pred_frames"))
    both = both.withColumn("why", F.when(few, "too_few").when(again, "repeated_time").when(F.col("hi") <= F.col("lo"), "no_common_span"))
    both = stored(both.select("clip", "lo", "hi", "why"), "cameras")
    fine = both.where("why IS NULL")
    asks = fine.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("side", F.explode(F.array(F.lit("gt"), F.lit("pred"))))
    asks = asks.select("side", "clip", F.when(F.col("j") == n - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("j") / float(n - 1)).alias("t"))
    at = series.resample_linear(rows.join(fine.select("clip"), "clip", "left_semi"), asks, ["side", "clip"], values=AXES)
    radius = at.groupBy("clip", "side").agg(rms_radius(*AXES).alias("r")).groupBy("clip").pivot("side", ["gt", "pred"]).agg(F.first("r"))
    radius = radius.select("clip", F.col("gt").alias("gt_radius"), F.col("pred").alias("pred_radius"))
    out = both.join(radius, "clip", "left").join(spread, "clip", "left")
    frozen = [(F.coalesce(F.col(f"{s}_spread"), F.lit(0.0)) > 0) & (F.col(f"{s}_radius") < still * F.col(f"{s}_spread")) for s in ("gt", "pred")]
    flat = (F.col("pred_radius") <= 1e-9) | (F.col("gt_radius") <= 0)
    why = F.coalesce("why", F.when(frozen[0] | frozen[1], "still_camera").when(flat, "degenerate"))
    scale = F.when(why.isNull(), F.col("gt_radius") / F.col("pred_radius")).otherwise(1.0)
    return out.select("clip", scale.alias("scale"), F.when(why.isNull(), "camera").otherwise("none").alias("used"), why.alias("why"), "gt_radius", "pred_radius")


def spread_scale(gt: Column, pred: Column) -> Column:
    """Ratio of the spreads of true and predicted objects, 1 if either is a point: what is left where the cameras tell nothing."""
    return F.when((pred > 1e-9) & (gt > 0), gt / pred).otherwise(1.0)


MOMENTS = ("n", "gx", "gz", "px", "pz", "xx", "zz", "xz", "zx")
COSTS = "cost double, start double, " + ", ".join(f"m_{m} double" for m in MOMENTS)


def pair_costs(pairs: DataFrame, n: int) -> DataFrame:
    """Add the mean distance ``cost`` of two grids over the times both support, the distance ``start`` at the first, and the moments of a plane fit.

    ``pairs`` has ``g`` and ``p`` (grids) and ``scale, yaw, tx, tz``, which move ``p`` first. No common time gives a null cost. The moments
    are of the true and the scaled, not yet turned points.
    """
    keep = [c for c in pairs.columns if c not in ("g", "p", "scale", "yaw", "tx", "tz")]
    types = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, p = (batch.column(c).flatten().to_numpy().reshape(-1, 3, n) for c in ("g", "p"))
            s, yaw, tx, tz = (batch.column(c).to_numpy()[:, None] for c in ("scale", "yaw", "tx", "tz"))
            p = p * s[:, :, None]
            c, w = np.cos(yaw), np.sin(yaw)
            d = np.sqrt((g[:, 0] - c * p[:, 0] - w * p[:, 2] - tx) ** 2 + (g[:, 1] - p[:, 1]) ** 2 + (g[:, 2] + w * p[:, 0] - c * p[:, 2] - tz) ** 2)
            good = ~np.isnan(d)
            count = good.sum(axis=1)
            gx, gz, px, pz = (np.where(good, v, 0.0) for v in (g[:, 0], g[:, 2], p[:, 0], p[:, 2]))
            cost = np.where(count > 0, np.where(good, d, 0.0).sum(axis=1) / np.maximum(count, 1), np.nan)
            sums = [count.astype(float), *(v.sum(axis=1) for v in (gx, gz, px, pz, gx * px, gz * pz, gx * pz, gz * px))]
            new = [pa.array(cost, from_pandas=True), pa.array(d[:, 0], from_pandas=True), *(pa.array(v) for v in sums)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, "cost", "start", *(f"m_{m}" for m in MOMENTS)])

    return pairs.mapInArrow(run, f"{types}, {COSTS}")


def plane_fit(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Turn (radians) and shift that bring points nearest to theirs, from summed moments; one point is only shifted."""
    m = moments.groupBy(*keys).agg(*[F.sum(f"m_{c}").alias(c) for c in MOMENTS]).where("n > 0")
    mean = {c: F.col(c) / F.col("n") for c in ("gx", "gz", "px", "pz")}
    cross = lambda s, a, b: F.col(s) / F.col("n") - mean[a] * mean[b]
    turn = F.atan2(cross("xz", "gx", "pz") - cross("zx", "gz", "px"), cross("xx", "gx", "px") + cross("zz", "gz", "pz"))
    m = m.withColumn("yaw", F.when(F.col("n") >= 2, turn).otherwise(0.0))
    tx = mean["gx"] - (F.cos("yaw") * mean["px"] + F.sin("yaw") * mean["pz"])
    tz = mean["gz"] - (-F.sin("yaw") * mean["px"] + F.cos("yaw") * mean["pz"])
    return m.select(*keys, "yaw", tx.alias("tx"), tz.alias("tz"))


def window_errors(pairs: DataFrame, windows: DataFrame, p: SceneParams = SceneParams()) -> DataFrame:
    """Add to each pair and window of its clip ``coverage, distance, reason``: the mean distance over what both tracks support of the window.

    ``pairs`` has ``clip, g, p`` (samples) and ``scale, yaw, tx, tz``; ``windows`` is ``clip, window, w0, w1``. Each pair has a grid of its
    own, so nothing is extrapolated; below ``coverage`` of the window nothing is measured.
    """
    ends = [F.element_at(c, i)["t"] for c in ("g", "p") for i in (1, -1)]
    rows = pairs.join(windows, "clip").withColumns({"begin": F.greatest("w0", ends[0], ends[2]), "end": F.least("w1", ends[1], ends[3])})
    rows = rows.withColumn("coverage", F.greatest(F.col("end") - F.col("begin"), F.lit(0.0)) / (F.col("w1") - F.col("w0")))
    enough = (F.col("end") > F.col("begin")) & (F.col("coverage") >= p.coverage)
    rows = rows.withColumn("reason", F.when(~enough, "insufficient_time_coverage"))
    keep = [c for c in rows.columns if c not in ("g", "p", "scale", "yaw", "tx", "tz", "w0", "w1", "begin", "end")]
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (go, gf), (po, pf) = _lists(batch.column("g")), _lists(batch.column("p"))
            s, yaw, tx, tz, begin, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("scale", "yaw", "tx", "tz", "begin", "end"))
            skip = batch.column("reason").is_valid().to_numpy(zero_copy_only=False)
            out = np.full(batch.num_rows, np.nan)
            for i in np.flatnonzero(~skip):
                times = np.linspace(begin[i], end[i], p.samples)
                a = _interpolated(gf, go[i], go[i + 1], times)
                b = s[i] * _interpolated(pf, po[i], po[i + 1], times)
                c, w = math.cos(yaw[i]), math.sin(yaw[i])
                moved = np.stack([c * b[0] + w * b[2] + tx[i], b[1], -w * b[0] + c * b[2] + tz[i]])
                out[i] = np.sqrt(((a - moved) ** 2).sum(axis=0)).mean()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, from_pandas=True)], names=[*keep, "distance"])

    return rows.select(*keep, "g", "p", "scale", "yaw", "tx", "tz", "begin", "end").mapInArrow(run, f"{types}, distance double")


def build_scene_tracks(states: DataFrame) -> DataFrame:
    """One row per track: ``side, clip, kind, instance, node, samples`` in time and ``fault`` (null if it is fine)."""
    bad = F.lit(False)
    for c in ("t", *AXES):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rows = states.withColumn("__bad", bad)
    out = rows.groupBy(*TRACK).agg(
        F.min("node").alias("node"), F.array_sort(F.collect_list(F.struct("t", *AXES))).alias("samples"), F.countDistinct("t").alias("__times"), F.count(F.lit(1)).alias("__n"),
        F.max("__bad").alias("__bad"), F.countDistinct("node").alias("__nodes"),
    )
    fault = F.when(F.col("__bad"), "not_finite").when(F.col("__times") < F.col("__n"), "repeated_time").when(F.col("__nodes") > 1, "changes_node")
    return out.select(*TRACK, "node", F.col("samples").cast(SAMPLES).alias("samples"), fault.alias("fault"))


def scene_status(tracks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``clip, status, t0, t1``: ``ok``, or why a clip is not evaluated (``invalid_states``, ``no_truth``, ``state_program_mismatch``, ``no_time_span``)."""
    known = nodes.select("side", "clip", "node").distinct().withColumn("known", F.lit(True))
    t = tracks.join(known, ["side", "clip", "node"], "left")
    mine = (F.col("side") == "gt")
    ends = lambda i: F.element_at("samples", i)["t"]
    per = t.groupBy("clip").agg(
        F.max(F.col("fault").isNotNull()).alias("faulty"), F.count_if(mine & (F.col("kind") == "object")).alias("truths"),
        F.count_if((F.col("kind") == "object") & F.col("known").isNull()).alias("unknown"), F.min(F.when(mine, ends(1))).alias("t0"), F.max(F.when(mine, ends(-1))).alias("t1"),
    )
    status = F.when(F.col("faulty"), "invalid_states").when(F.col("truths") == 0, "no_truth").when(F.col("unknown") > 0, "state_program_mismatch")
    return per.select("clip", status.when(~(F.col("t1") > F.col("t0")), "no_time_span").otherwise("ok").alias("status"), "t0", "t1")


def _matched(costs: DataFrame, by: str, limit: float) -> DataFrame:
    found = M.match_costs(costs.select("clip", F.col("gt_no").alias("gt"), F.col("pred_no").alias("pred"), F.col(by).alias("cost")), ["clip"], limit)
    return found.select("clip", F.col("gt").alias("gt_no"), F.col("pred").alias("pred_no"), F.col("cost").alias("matched_at"))


@dataclass(frozen=True)
class SceneTables:
    """``status`` and ``gauges`` have a row per clip, ``pairs`` one per true object and window, ``windows`` one per clip and window, ``clips`` one per
    evaluated clip, ``confusions`` (clip, what, truth, predicted, n) counts of matched pairs, ``scene_pairs`` the matching of objects and structures."""

    status: DataFrame
    gauges: DataFrame
    pairs: DataFrame
    windows: DataFrame
    clips: DataFrame
    confusions: DataFrame
    scene_pairs: DataFrame


def find_gauges(fit: DataFrame, spans: DataFrame, cameras: DataFrame | None, p: SceneParams) -> DataFrame:
    """``clip, scale, yaw, tx, tz`` and where the scale is from, fitted on the objects' grids of the fit window and frozen.

    First a scale (from the cameras; by the objects' spread where they tell nothing), which stays; then the turn and shift with the most inliers; then
    the best turn and shift of the pairs matched under them.
    """
    limit = p.gauge_dist if p.gauge_dist is not None else p.max_dist
    objects = fit.where("kind = 'object'")
    none = F.lit(None).cast("string")
    if p.gauge == "none":
        zero = F.lit(0.0)
        return spans.select("clip", F.lit(1.0).alias("scale"), zero.alias("yaw"), zero.alias("tx"), zero.alias("tz"), F.lit("off").alias("used"), none.alias("why"), F.lit(0).alias("inliers"))
    if p.gauge == "similarity":
        wide = lambda s: rms_radius(*[f"{s}_{c}" for c in AXES]).alias(f"{s}_spread")
        split = objects.select("clip", *[F.when(F.col("side") == s, F.col(f"c{c}")).alias(f"{s}_{c}") for s in ("gt", "pred") for c in AXES])
        spread = stored(split.groupBy("clip").agg(wide("gt"), wide("pred")), "spread")
        shot = spans.select("clip", F.col("t0").alias("begin"), F.col("cut").alias("end"))
        told = camera_scale(cameras, shot, spread, p.camera_samples, p.still).join(spread, "clip", "left")
        use = (F.col("used") == "camera") & (F.col("scale") != 1.0)
        by_spread = spread_scale(F.coalesce("gt_spread", F.lit(0.0)), F.coalesce("pred_spread", F.lit(0.0)))
        scales = told.select("clip", F.when(use, F.col("scale")).otherwise(by_spread).alias("scale"), "used", "why")
    else:
        scales = spans.select("clip", F.lit(1.0).alias("scale"), F.lit("off").alias("used"), none.alias("why"))
    scales = stored(scales, "scales")
    k = F.when(F.col("side") == "pred", F.col("scale")).otherwise(1.0)
    points = objects.join(scales, "clip").select("clip", "side", F.col("no").alias("id"), *[(F.col(f"c{c}") * k).alias(c) for c in AXES])
    coarse = M.coarse_gauge(points, ["clip"], limit).select("clip", F.radians("yaw_deg").alias("yaw"), "tx", "tz", "inliers")
    rough = stored(scales.join(coarse, "clip"), "rough")
    costs = stored(_costs(objects, rough, p), "rough-costs")
    pairs = _matched(costs, "cost", p.max_dist)
    fine = plane_fit(costs.join(pairs, ["clip", "gt_no", "pred_no"]), ["clip"]).select("clip", F.struct("yaw", "tx", "tz").alias("fine"))
    best = F.coalesce("fine", F.struct("yaw", "tx", "tz"))
    return rough.join(fine, "clip", "left").withColumn("best", best).select("clip", "scale", "best.*", "used", "why", "inliers")


def _costs(fit: DataFrame, gauges: DataFrame, p: SceneParams) -> DataFrame:
    """Costs of all pairs of a true and a predicted track of one clip."""
    side = lambda s, g: fit.where(F.col("side") == s).select("clip", F.col("no").alias(f"{s}_no"), F.col("kind").alias(f"{s}_kind"), F.col("grid").alias(g))
    pairs = side("gt", "g").join(side("pred", "p"), "clip").join(gauges.select("clip", "scale", "yaw", "tx", "tz"), "clip")
    return pair_costs(pairs, p.samples)


def evaluate_scenes(states: DataFrame, nodes: DataFrame, cameras: DataFrame | None = None, p: SceneParams = SceneParams()) -> SceneTables:
    """Evaluate predicted scenes against true ones, clip by clip.

    ``states(side, clip, kind, instance, node, t, x, y, z)`` with side ``gt`` or ``pred``, kind ``object`` or ``static``; ``nodes(side, clip, node,
    class, motion, shape, extent, asset_ratios)``; ``cameras(side, clip, t, x, y, z)`` for a gauge with scale. The cut is at ``1 - holdout`` of the
    truth's span. Gauge and pairs come from samples up to the cut on both sides and are frozen: nothing later can change them. Objects are matched alone,
    then objects and structures together under the same gauge. Windows: ``fit``, ``full`` and ``holdout``.
    """
    tracks = stored(build_scene_tracks(states), "tracks")
    status = stored(scene_status(tracks, nodes), "status")
    cut = F.col("t0") + (F.col("t1") - F.col("t0")) * F.lit(1 - p.holdout)
    spans = stored(status.where("status = 'ok'").select("clip", "t0", "t1", cut.alias("cut")), "spans")
    key = F.when(F.col("kind") == "static", F.concat(F.lit("static::"), F.col("instance"))).otherwise(F.col("instance"))
    number = F.row_number().over(Window.partitionBy("clip", "side").orderBy(key)).cast("long")
    tracks = stored(tracks.join(spans, "clip").withColumn("no", number).drop("fault"), "numbered")
    early = F.filter("samples", lambda s: s["t"] <= F.col("cut"))
    seen = tracks.withColumn("samples", early).where(F.size("samples") > 0)
    fit = stored(resample_on_grid(seen.select("side", "clip", "kind", "no", "samples", F.col("t0").alias("begin"), F.col("cut").alias("end")), p.samples), "fit")
    gauges = stored(find_gauges(fit, spans, cameras, p), "gauges")

    costs = stored(_costs(fit, gauges, p), "costs")
    by = "cost" if p.match_on == "mean" else "start"
    objects = costs.where("gt_kind = 'object' AND pred_kind = 'object'")
    pairs = stored(_matched(objects, by, p.max_dist), "pairs")
    other = _matched(objects, "start", p.max_dist).select("clip", "gt_no", F.lit(True).alias("at_start"))
    scene = stored(_matched(costs, by, p.max_dist), "scene-pairs")

    windows = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(a).alias("w0"), F.col(b).alias("w1")) for n, a, b in (("fit", "t0", "cut"), ("full", "t0", "t1"), ("holdout", "cut", "t1"))]))
    asked = spans.select("clip", windows.alias("w")).select("clip", "w.*")
    side = lambda s, name: tracks.where((F.col("side") == s) & (F.col("kind") == "object")).select(
        "clip", F.col("no").alias(f"{s}_no"), F.col("instance").alias(s), F.col("node").alias(f"{s}_node"), *([F.col("samples").alias(name)] if name else []))
    truths = side("gt", None).join(asked.select("clip", "window"), "clip").join(other, ["clip", "gt_no"], "left")
    measured = pairs.join(side("gt", "g"), ["clip", "gt_no"]).join(side("pred", "p"), ["clip", "pred_no"]).join(gauges.select("clip", "scale", "yaw", "tx", "tz"), "clip")
    measured = window_errors(measured.drop("gt", "gt_node", "matched_at"), asked, p)
    observed = fit.where("side = 'gt' AND kind = 'object'").select("clip", F.col("no").alias("gt_no"), F.lit(True).alias("observed"))
    errors = truths.join(measured, ["clip", "gt_no", "window"], "left").join(observed, ["clip", "gt_no"], "left")
    why = F.when(F.col("pred").isNull(), F.when(F.col("observed"), "no_prefix_match").otherwise("not_observed_in_prefix")).otherwise(F.col("reason"))
    errors = errors.select("clip", "window", "gt", "gt_node", "pred", "pred_node", "coverage", "distance", why.alias("reason"), F.coalesce("at_start", F.lit(False)).alias("at_start"))
    errors = stored(errors, "errors")
    return SceneTables(status, gauges, errors, _window_table(errors), *_clip_tables(errors, scene, tracks, nodes))


def _window_table(errors: DataFrame) -> DataFrame:
    n, whole = F.count("distance"), F.count_if(F.col("distance").isNotNull() & (F.col("coverage") == 1))
    state = F.when(whole == F.count(F.lit(1)), "complete").when(n > 0, "partial").otherwise("unavailable")
    return errors.groupBy("clip", "window").agg(F.count(F.lit(1)).alias("n_gt"), n.alias("n"), F.percentile("distance", F.lit(0.5)).alias("median"), F.max("distance").alias("max"), state.alias("state"))


def asset_shape_error(ratios: Column, truth: Column) -> Column:
    """How far an asset's own edge ratios are from those of the true node; null without either."""
    return F.when(ratios.isNotNull() & truth.isNotNull(), shape_error(ratios, truth))


def agreement(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``clip, gt_node, pred_node`` with both nodes' classes, motions and shapes and the errors of shape, scale and chosen asset."""
    side = lambda s: nodes.where(F.col("side") == s).select("clip", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "class", "motion", "shape", "extent", "asset_ratios")])
    j = pairs.join(side("gt"), ["clip", "gt_node"], "left").join(side("pred"), ["clip", "pred_node"], "left")
    a, b = (F.lower(F.trim(F.coalesce(f"{s}_class", F.lit("")))) for s in ("gt", "pred"))
    sized = F.col("gt_extent").isNotNull() & F.col("pred_extent").isNotNull()
    return j.withColumns({
        "same_class": (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)),
        "gt_motion": F.coalesce("gt_motion", F.lit("static")), "pred_motion": F.coalesce("pred_motion", F.lit("static")),
        "shape_error": F.when(sized, shape_error(F.col("gt_extent"), F.col("pred_extent"))),
        "scale_ratio": F.when(sized, scale_ratio(F.col("gt_extent"), F.col("pred_extent"))),
        "asset_error": asset_shape_error(F.col("pred_asset_ratios"), F.col("gt_extent")),
    })


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def summarise(agreed: DataFrame) -> DataFrame:
    """Per clip: how many pairs, and how they agree in class, motion, shape and scale. Shares of nothing are null."""
    median = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    shaped = F.col("gt_shape").isNotNull() & F.col("pred_shape").isNotNull()
    n = F.count(F.lit(1))
    return agreed.groupBy("clip").agg(
        n.alias("matched"), F.count_if("same_class").alias("class_correct"), _share(F.count_if(F.col("gt_motion") == F.col("pred_motion")), n).alias("motion_accuracy"),
        F.count_if(shaped).alias("shape_n"), _share(F.count_if(shaped & (F.col("gt_shape") == F.col("pred_shape"))), F.count_if(shaped)).alias("shape_accuracy"),
        F.count("shape_error").alias("geometry_n"), median("shape_error"), median("scale_ratio"), median("asset_error"),
        _share(F.count_if(F.col("shape_error") <= 0.2), F.count("shape_error")).alias("shape_ok"),
        _share(F.count_if(F.col("scale_ratio").between(0.8, 1.25)), F.count("scale_ratio")).alias("scale_ok"),
    )


def confusions(agreed: DataFrame, kinds: DataFrame) -> DataFrame:
    """``clip, what, truth, predicted, n``: motion types and drawn shapes of matched objects, kinds of matched nodes (``kinds``: clip, truth, predicted)."""
    pick = lambda what, a, b: agreed.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("clip", F.lit(what).alias("what"), F.col(a).alias("truth"), F.col(b).alias("predicted"))
    rows = pick("motion", "gt_motion", "pred_motion").unionByName(pick("shape", "gt_shape", "pred_shape")).unionByName(kinds.select("clip", F.lit("kind").alias("what"), "truth", "predicted"))
    return rows.groupBy("clip", "what", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _clip_tables(errors: DataFrame, scene: DataFrame, tracks: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    whole = errors.where("window = 'full'")
    agreed = stored(agreement(whole.where("pred IS NOT NULL").select("clip", "gt_node", "pred_node"), nodes), "agreed")
    side = lambda s, out: tracks.where(F.col("side") == s).select("clip", F.col("no").alias(f"{s}_no"), F.col("kind").alias(out), F.col("instance").alias(s))
    kinds = scene.join(side("gt", "truth"), ["clip", "gt_no"]).join(side("pred", "predicted"), ["clip", "pred_no"]).select("clip", "gt", "pred", "truth", "predicted")
    kinds = stored(kinds, "kinds")
    of = lambda s, k=None: F.count_if((F.col("side") == s) & (F.lit(True) if k is None else F.col("kind") == k))
    sizes = tracks.groupBy("clip").agg(of("gt", "object").alias("n_gt"), of("pred", "object").alias("n_pred"), of("gt").alias("scene_gt"), of("pred").alias("scene_pred"))
    starts = whole.groupBy("clip").agg(F.count_if("at_start").alias("matched_at_start"), F.count_if(F.col("at_start") & F.col("pred").isNull()).alias("only_at_start"))
    out = sizes.join(summarise(agreed), "clip", "left").join(starts, "clip", "left").join(kinds.groupBy("clip").agg(F.count(F.lit(1)).alias("scene_matched")), "clip", "left")
    out = out.na.fill(0, ["matched", "class_correct", "shape_n", "geometry_n", "scene_matched"])
    rate = {"recall": ("matched", "n_gt"), "precision": ("matched", "n_pred"), "class_accuracy": ("class_correct", "matched"), "scene_recall": ("scene_matched", "scene_gt"), "scene_precision": ("scene_matched", "scene_pred")}
    out = out.withColumns({name: _share(F.col(a), F.col(b)) for name, (a, b) in rate.items()})
    return out, confusions(agreed, kinds), kinds

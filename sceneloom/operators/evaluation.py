"""Evaluation tables and statistics: exact medians, pooled per object or per run, never one total score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.functions.columns import slug, upper_median
from sceneloom.shared import stored, with_lookup


def evaluate_pairs(truth: DataFrame, predicted: DataFrame, keys: list[str], error: Column, limit: float) -> DataFrame:
    """Truth rows with their prediction (matched by identity): distance, whether it counts as found, class agreement.

    Truths without a prediction keep null distances; they are misses, not zeros.
    """
    j = truth.join(predicted, keys, "left")
    return j.withColumn("distance", error).withColumn("found", F.coalesce(F.col("distance") <= limit, F.lit(False)))


def run_summary(evaluated: DataFrame, predicted: DataFrame, run: str) -> DataFrame:
    """Recall, precision and median error of each run."""
    g = evaluated.groupBy(run).agg(F.count(F.lit(1)).alias("n_gt"), F.count_if("found").alias("n_matched"), F.percentile(F.when(F.col("found"), F.col("distance")), F.lit(0.5)).alias("median_error"))
    p = predicted.groupBy(run).agg(F.count(F.lit(1)).alias("n_pred"))
    j = g.join(p, run, "full").na.fill(0, ["n_gt", "n_matched", "n_pred"])
    return j.withColumn("recall", F.when(F.col("n_gt") > 0, F.col("n_matched") / F.col("n_gt"))).withColumn("precision", F.when(F.col("n_pred") > 0, F.col("n_matched") / F.col("n_pred")))


def weighted_median(rows: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Exact median by counts: values are counted before the shuffle, so a few keys with many rows do not skew."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5D, __n)").alias(into))


def pool_report(evaluated: DataFrame, runs: DataFrame, config: str) -> DataFrame:
    """Per config: object metrics pooled over objects, run metrics over runs. Sample deviation is 0 for one run."""
    objects = evaluated.groupBy(config).agg(F.count(F.lit(1)).alias("n_objects"), F.count_if("found").alias("n_found"), F.avg(F.col("class_ok").cast("double")).alias("class_accuracy"))
    errors = weighted_median(evaluated.where("found"), [config], "distance", "median_error")
    shapes = weighted_median(evaluated.where("found"), [config], "shape_error", "median_shape_error")
    per_run = runs.groupBy(config).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("recall").alias("mean_recall"), F.coalesce(F.stddev_samp("recall"), F.lit(0.0)).alias("std_recall"), F.avg("precision").alias("mean_precision")
    )
    return objects.join(errors, config, "left").join(shapes, config, "left").join(per_run, config, "left")


def metric_summary(rows: DataFrame, config: str, metrics: list[str]) -> DataFrame:
    """``config, metric, n, mean, std, median``: over the rows where a metric is known; the deviation of one row is 0.

    Values are counted before the shuffle, so a few configs with many rows do not skew.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    known = rows.select(config, values.alias("x")).select(config, "x.*").where("value IS NOT NULL")
    counted = known.groupBy(config, "metric", "value").agg(F.count(F.lit(1)).alias("__n"))
    n, total, square = F.sum("__n"), F.sum(F.col("value") * F.col("__n")), F.sum(F.col("value") * F.col("value") * F.col("__n"))
    out = counted.groupBy(config, "metric").agg(n.alias("n"), (total / n).alias("mean"), (square - total * total / n).alias("__s"), F.expr("percentile(value, 0.5D, __n)").alias("median"))
    spread = F.sqrt(F.greatest(F.col("__s"), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
    return out.select(config, "metric", "n", "mean", F.when(F.col("n") > 1, spread).otherwise(0.0).alias("std"), "median")


def motion_accuracy(rows: DataFrame, config: str, truth: str, guess: str, rest: str = "static") -> DataFrame:
    """Per config: accuracy of the motion types of found objects, and what always guessing ``rest`` would reach."""
    known = rows.where(F.col(guess).isNotNull())
    return known.groupBy(config).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"), F.avg((F.col(truth) == rest).cast("double")).alias("always_static"))


def report_table(pooled: DataFrame, config: str, columns: dict[str, int]) -> DataFrame:
    """One text row per config, numbers with a fixed number of places, n/a for what is missing."""
    cells = [F.coalesce(F.format_number(F.col(c), places), F.lit("n/a")).alias(c) for c, places in columns.items()]
    return pooled.select(config, *cells).withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", config, *columns), F.lit(" |")))


def quality_metrics(observations: DataFrame, frames: DataFrame, severe: float = 0.3) -> DataFrame:
    """Per object: coverage, measured share, visibility, gaps in the registry's order, span ratio.

    ``observations(clip, object_id, frame, t, visible, depth)``, ``frames(clip, frame, t)``; unknown is null and never imputed.
    """
    order = frames.withColumn("__pos", F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1)
    clips = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("registered"), (F.max("t") - F.min("t")).alias("duration"))
    o = observations.groupBy("clip", "object_id").agg(
        F.count(F.lit(1)).alias("observations"), F.avg(F.col("depth").isNotNull().cast("double")).alias("depth_measured"), F.avg("visible").alias("mean_visible"),
        F.avg((F.col("visible") <= severe).cast("double")).alias("severe_occlusion"), (F.max("t") - F.min("t")).alias("span"),
    )
    seen = observations.select("clip", "object_id", "frame").distinct().join(order.select("clip", "frame", "__pos"), ["clip", "frame"])
    step = F.col("__pos") - F.lag("__pos").over(Window.partitionBy("clip", "object_id").orderBy("__pos")) - 1
    gaps = seen.withColumn("__gap", F.coalesce(step, F.lit(0))).groupBy("clip", "object_id").agg(F.count(F.lit(1)).alias("frames_seen"), F.count_if(F.col("__gap") > 0).alias("gap_count"), F.max("__gap").alias("max_gap"))
    j = o.join(gaps, ["clip", "object_id"], "left").join(clips, "clip").na.fill(0, ["frames_seen", "gap_count", "max_gap"])
    return j.withColumn("coverage", F.col("frames_seen") / F.col("registered")).withColumn("span_ratio", F.when(F.col("duration") > 0, F.least(F.col("span") / F.col("duration"), F.lit(1.0))).otherwise(0.0))


def quality_gate(metrics: DataFrame, clip: str, block: Column, warn: Column) -> DataFrame:
    """proceed, warn or block for each clip, from conditions on its objects; a single blocking object blocks."""
    g = metrics.groupBy(clip).agg(F.count(F.lit(1)).alias("objects"), F.bool_or(F.coalesce(block, F.lit(False))).alias("__b"), F.bool_or(F.coalesce(warn, F.lit(False))).alias("__w"))
    return g.withColumn("decision", F.when(F.col("__b"), "block").when(F.col("__w"), "warn").otherwise("proceed")).drop("__b", "__w")


def identity_entropy(candidates: DataFrame, keys: list[str], hypothesis: str, confidence: str) -> DataFrame:
    """Largest normalised entropy over an object's hypotheses, of those with two or more known confidences."""
    by = Window.partitionBy(*keys, hypothesis)
    p = candidates.withColumn("__s", F.sum(confidence).over(by)).withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__k", F.count(confidence).over(by))
    # Confidences that add up to nothing have no shares; such a hypothesis is not usable below.
    p = p.withColumn("__p", F.col(confidence) / F.when(F.col("__s") != 0, F.col("__s")))
    e = p.groupBy(*keys, hypothesis, "__n", "__k", "__s").agg((-F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.ln("__p")))).alias("__e"))
    usable = (F.col("__k") == F.col("__n")) & (F.col("__n") >= 2) & (F.col("__s") > 0)
    return e.groupBy(*keys).agg(F.max(F.when(usable, F.col("__e") / F.ln(F.col("__n").cast("double")))).alias("entropy"), F.bool_or(~usable).alias("has_unknown"))


def motion_support(candidates: DataFrame, keys: list[str], confidence: str, primary: str) -> DataFrame:
    """Primary confidence, the best candidate's, and its margin over the second."""
    ranked = candidates.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(confidence), primary)))
    nth = lambda k: F.max(F.when(F.col("__r") == k, F.col(confidence)))
    return ranked.groupBy(*keys).agg(F.first(primary, True).alias("primary"), nth(1).alias("best"), (nth(1) - nth(2)).alias("margin"))


def primary_support(objects: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Primary confidence by its fallback chain (attribute, then guess), the best candidate's, and the margin (stated, else from the best two).

    ``objects(keys, attribute_conf, guess_conf, stated_margin)``, ``candidates(keys, confidence)``; what is unknown is null.
    """
    ranked = candidates.where("confidence IS NOT NULL").withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"))))
    nth = lambda k: F.max(F.when(F.col("__r") == k, F.col("confidence")))
    top = ranked.groupBy(*keys).agg(nth(1).alias("best"), nth(2).alias("__second"))
    out = objects.join(top, keys, "left")
    return out.select(*keys, F.coalesce("attribute_conf", "guess_conf").alias("primary"), "best", F.coalesce(F.col("stated_margin"), F.col("best") - F.col("__second")).alias("margin"))


def coverage_and_recall(requests: DataFrame, evidence: DataFrame, nodes: DataFrame, clip: str) -> DataFrame:
    """Per clip the part of asset requests that the library met, and of evidence objects that the program has (by id or slug).

    ``requests(clip, resolved)``, ``evidence(clip, id)``, ``nodes(clip, id)``. Without requests, or without evidence, the part is null.
    """
    met = requests.groupBy(clip).agg(F.avg(F.startswith("resolved", F.lit("library")).cast("double")).alias("asset_coverage"))
    ids = nodes.select(clip, "id").distinct()
    forms = evidence.select(clip, F.col("id").alias("__e"), F.explode(F.array_distinct(F.array("id", slug(F.col("id"))))).alias("id"))
    hit = forms.join(ids, [clip, "id"]).select(clip, "__e").distinct().groupBy(clip).agg(F.count(F.lit(1)).alias("__hit"))
    n = evidence.select(clip, "id").distinct().groupBy(clip).agg(F.count(F.lit(1)).alias("__n"))
    recall = n.join(hit, clip, "left").select(clip, (F.coalesce("__hit", F.lit(0)) / F.col("__n")).alias("object_recall"))
    return met.join(recall, clip, "full")


def interaction_success(probes: DataFrame) -> DataFrame:
    """Whether each manipulation probe succeeded, by its mode (fixed values).

    Free: lifted half way, followed within 0.25, finite, not fallen through, resting below 0.5. A slide must move, stay within 0.02 of its axis and
    overshoot at most 0.02; a hinge must move and overshoot at most 2 degrees; a missing overshoot is none.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    free = (F.col("lift") >= 0.5) & (F.col("follow") <= 0.25) & yes("finite") & ~yes("fell") & (F.col("speed") < 0.5)
    slide = yes("moves") & (F.col("drift") <= 0.02) & (F.coalesce("overshoot", F.lit(0.0)) <= 0.02)
    hinge = yes("moves") & (F.coalesce("overshoot", F.lit(0.0)) <= 2.0)
    ok = F.when(F.col("mode") == "free", free).when(F.col("mode") == "slide", slide).when(F.col("mode").isNotNull(), hinge)
    return probes.withColumn("ok", F.coalesce(ok, F.lit(False)))


def declared_and_measured(probes: DataFrame, objects: DataFrame, clip: str) -> DataFrame:
    """Per clip: objects, those declared to be grabbed, those that work, and the two shares. ``probes`` has ``ok``, ``objects(clip, n)``."""
    p = probes.groupBy(clip).agg(F.count(F.lit(1)).alias("declared"), F.count_if("ok").alias("works"))
    out = objects.join(p, clip, "left").na.fill(0, ["declared", "works"])
    return out.select(clip, F.col("n").alias("objects"), "declared", "works", F.when(F.col("declared") > 0, F.col("works") / F.col("declared")).alias("success_share"), F.when(F.col("n") > 0, F.col("works") / F.col("n")).alias("interactive_share"))


def fidelity(rows: DataFrame, keys: list[str], written: str, observed: str) -> DataFrame:
    """Upper median of the absolute log size ratio, and its outliers (beyond a factor of two)."""
    v = F.abs(F.ln(F.col(written) / F.col(observed)))
    out = rows.where((F.col(written) > 0) & (F.col(observed) > 0)).groupBy(*keys).agg(F.array_sort(F.collect_list(v)).alias("__v"), F.count(F.lit(1)).alias("n"), F.count_if(v > math.log(2)).alias("outliers"))
    return out.select(*keys, "n", upper_median(F.col("__v")).alias("log_size_error"), "outliers")


def interactivity(rows: DataFrame, keys: list[str], motion: str, grab: str) -> DataFrame:
    """Shares of objects that can be taken, are scripted, articulated or simulated."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    m = F.col(motion)
    return rows.groupBy(*keys).agg(
        share(F.col(grab) == "free").alias("manipulable"), share(m.isin("trajectory", "periodic")).alias("scripted"), share(m.isin("revolute", "prismatic")).alias("articulated"), share(m == "dynamic").alias("simulated")
    )


def interaction_summary(probes: DataFrame, mode: str, lift: str, follow: str, speed: str) -> DataFrame:
    """Success shares and lower medians of free-grab probes, by mode.

    The median comes from counts by range: 1,024 ranges of a mode are counted, and only the values of the range that holds
    the middle are ordered.
    """
    ok = (F.col(lift) >= 0.5) & (F.col(follow) <= 0.25) & (F.col(speed) < 0.5)
    v = F.col(follow).cast("double")
    odd = F.isnan(v) | (F.abs(v) == math.inf)
    out = probes.groupBy(mode).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("success"), F.floor((F.count(v) - 1) / 2).alias("__mid"),
        F.min(F.when(~odd, v)).alias("__lo"), F.max(F.when(~odd, v)).alias("__hi"),
    )
    out = stored(out, "modes")
    counts = probes.where(v.isNotNull()).groupBy(mode, v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    x = F.col("__v")
    # Half values, so that the width of the widest range of doubles is one too.
    at = F.floor((x / 2 - F.col("__lo") / 2) / F.nullif(F.col("__hi") / 2 - F.col("__lo") / 2, F.lit(0.0)) * 1024)
    part = F.when(F.isnan(x), 1026).when(x == math.inf, 1025).when(x == -math.inf, -1).otherwise(F.coalesce(at, F.lit(0)))
    placed = stored(with_lookup(counts, out.select(mode, "__mid", "__lo", "__hi"), [mode], "inner").select(mode, "__v", "__c", "__mid", part.alias("__p")), "values")
    by = Window.partitionBy(mode).rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy(mode, "__p").agg(F.sum("__c").alias("__s"), F.max("__mid").alias("__mid")).withColumn("__upto", F.sum("__s").over(by.orderBy("__p")))
    ranges = ranges.where((F.col("__upto") > F.col("__mid")) & (F.col("__upto") - F.col("__s") <= F.col("__mid")))
    middle = with_lookup(placed, stored(ranges.select(mode, "__p", (F.col("__upto") - F.col("__s")).alias("__before")), "middle"), [mode, "__p"], "inner")
    middle = middle.withColumn("__upto", F.col("__before") + F.sum("__c").over(by.orderBy("__v"))).where(F.col("__upto") > F.col("__mid"))
    median = stored(middle.groupBy(mode).agg(F.min("__v").alias("follow_error")), "medians")
    return with_lookup(out.select(mode, "n", "success"), median, [mode]).select(mode, "n", "success", "follow_error")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def confusion_rescore(table: DataFrame, truth: str, guess: str, suppress: list[str], rest: str) -> DataFrame:
    """Accuracy if the suppressed guesses became ``rest``, against always guessing it; moving-or-not precision and recall."""
    g = F.when(F.col(guess).isin(suppress), F.lit(rest)).otherwise(F.col(guess))
    t = F.col(truth)
    total = F.sum("n")
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    moving_hit, moving_said, moving = part((t != rest) & (g != rest)), part(g != rest), part(t != rest)
    return table.agg(
        total.alias("n"), (part(t == g) / total).alias("accuracy"), (part(t == rest) / total).alias("always_rest"), (moving_hit / F.greatest(moving_said, F.lit(1))).alias("moving_precision"),
        (moving_hit / F.greatest(moving, F.lit(1))).alias("moving_recall"), (moving / total).alias("base_rate"),
    )


def threshold_sweep(rows: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """TPR, FPR and F1 at each threshold (score at most the threshold says yes), and the best TPR - FPR: the first of ties.

    Scores are counted first; each distinct score then meets the short list of thresholds.
    """
    counted = rows.groupBy(score, positive).agg(F.count(F.lit(1)).alias("n"))
    t = counted.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    yes, pos = F.col(score) <= F.col("threshold"), F.col(positive)
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = t.groupBy("threshold").agg(part(yes & pos).alias("tp"), part(yes & ~pos).alias("fp"), part(~yes & pos).alias("fn"), part(~yes & ~pos).alias("tn"))
    out = out.withColumn("tpr", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).withColumn("fpr", F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)))
    out = out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("tpr") - F.col("fpr"), 9)), "threshold"))
    return out.withColumn("best", best == 1)


def best_split(rows: DataFrame, attributes: list[str], positive: str) -> DataFrame:
    """For each attribute the best of five percentile thresholds and two directions: keep share + reject share - 1."""
    long = rows.select(positive, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("value")) for a in attributes])).alias("x")).select(positive, "x.*").where("value IS NOT NULL")
    counted = long.groupBy("attribute", positive, "value").agg(F.count(F.lit(1)).alias("n"))
    cuts = counted.groupBy("attribute").agg(F.expr("percentile(value, array(0.1D, 0.25D, 0.5D, 0.75D, 0.9D), n)").alias("cuts"))
    tried = counted.join(F.broadcast(cuts), "attribute").withColumn("threshold", F.explode("cuts")).withColumn("direction", F.explode(F.array(F.lit("above"), F.lit("below"))))
    yes = F.when(F.col("direction") == "above", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    pos = F.col(positive)
    s = tried.groupBy("attribute", "threshold", "direction").agg((part(yes & pos) / F.greatest(part(pos), F.lit(1)) + part(~yes & ~pos) / F.greatest(part(~pos), F.lit(1)) - 1).alias("gain"))
    return s.withColumn("__r", F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc(F.round("gain", 9)), "threshold", "direction"))).where("__r = 1").drop("__r")


def rank_agreement(rows: DataFrame, family: str, a: str, b: str, least: int = 3) -> DataFrame:
    """Spearman correlation within each family, with the reason where there is none. Families are never pooled."""
    fine = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))

    def ranked(df: DataFrame, c: str) -> DataFrame:
        o = Window.partitionBy(family).orderBy(c)
        return df.withColumn(f"__{c}", F.rank().over(o) + (F.count(F.lit(1)).over(Window.partitionBy(family, c)) - 1) / 2)

    g = ranked(ranked(fine, a), b).groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(a).alias("__da"), F.countDistinct(b).alias("__db"), F.corr(f"__{a}", f"__{b}").alias("__r"))
    reason = F.when(F.col("n") < least, "too_few").when((F.col("__da") < 2) | (F.col("__db") < 2), "constant")
    return g.select(family, "n", F.when(reason.isNull(), F.col("__r")).alias("spearman"), F.coalesce(reason, F.lit("available")).alias("status"))


def monotone_check(rows: DataFrame, family: str, level: str, value: str, first: int = 5) -> DataFrame:
    """Whether the mean value never falls over the ``first`` levels of each family, and by how much it falls at most."""
    means = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(family, level).agg(F.avg(value).alias("__m"))
    o = Window.partitionBy(family).orderBy(level)
    steps = means.withColumn("__r", F.row_number().over(o)).where(F.col("__r") <= first).withColumn("__d", F.col("__m") - F.lag("__m").over(o))
    return steps.groupBy(family).agg(F.count(F.lit(1)).alias("levels"), F.coalesce(F.bool_and(F.col("__d") >= 0), F.lit(True)).alias("monotone"), F.greatest(F.lit(0.0), F.coalesce(-F.min("__d"), F.lit(0.0))).alias("worst_fall"))


def perturb(nodes: DataFrame, kinds: dict[str, dict[str, Column]], drop: dict[str, Column] | None = None, add: dict[str, tuple[Column, dict[str, Column]]] | None = None) -> DataFrame:
    """All corrupted variants of a table: ``variant`` names the corruption; columns are replaced, rows dropped where told, and copies of the
    rows where a condition holds are added with columns replaced (ghosts)."""
    drop, add = drop or {}, add or {}
    out = None
    for kind in sorted({*kinds, *drop, *add}):
        one = nodes.where(~drop[kind]) if kind in drop else nodes
        one = one.withColumns(kinds.get(kind, {}))
        if kind in add:
            where, changes = add[kind]
            one = one.unionByName(nodes.where(where).withColumns(changes))
        one = one.withColumn("variant", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def graded(nodes: DataFrame, levels: list[float], column: str) -> DataFrame:
    """A variant per level in which ``column`` is moved by it: ``variant`` is ``shift`` with the level in ``level``."""
    rows = nodes.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return rows.withColumn(column, F.col(column) + F.col("level")).withColumn("variant", F.lit("shift"))


def sensitivity(scores: DataFrame, base: str, metrics: list[str], expected: dict[str, dict[str, int]]) -> DataFrame:
    """How each variant moved each metric against ``base`` (a variant), and whether that is the way it should: ``variant, metric, delta, as_expected``.

    ``expected[variant][metric]`` is 1 (rises), -1 (falls) or 0 (stays within a millionth); a metric without one is not judged (null).
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = scores.select("variant", values.alias("x")).select("variant", "x.*")
    start = long.where(F.col("variant") == base).select("metric", F.col("value").alias("__b"))
    sign = F.lit(None).cast("int")
    for variant, ways in expected.items():
        for metric, way in ways.items():
            sign = F.when((F.col("variant") == variant) & (F.col("metric") == metric), way).otherwise(sign)
    out = long.where(F.col("variant") != base).join(start, "metric").withColumn("delta", F.col("value") - F.col("__b")).withColumn("__e", sign)
    fine = F.when(F.col("__e") == 0, F.abs("delta") <= 1e-6).when(F.col("__e").isNotNull(), F.signum("delta") == F.col("__e"))
    return out.select("variant", "metric", "delta", fine.alias("as_expected"))


def scale_by_framing(rows: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Median and spread ratios of predicted to true edges, per group."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy(*keys).agg(q(truth).alias("t"), q(predicted).alias("p"), F.count(F.lit(1)).alias("n"))
    spread = F.when(F.col("t")[2] > F.col("t")[0], (F.col("p")[2] - F.col("p")[0]) / (F.col("t")[2] - F.col("t")[0]))
    return g.select(*keys, "n", (F.col("p")[1] / F.col("t")[1]).alias("median_ratio"), spread.alias("spread_ratio"))


def structure_signal(rows: DataFrame, kind: str) -> DataFrame:
    """Quartiles of flatness (height over the wider side) by kind."""
    flat = F.col("ey") / F.greatest("ex", "ez")
    q = rows.groupBy(kind).agg(F.percentile(flat, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    return q.select(kind, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def dimension_ratios(rows: DataFrame, kind: str) -> DataFrame:
    """Per true kind the quartiles of height and of longest-edge ratios, predicted over true, of matched objects (``ex, ey, ez`` against ``qx, qy, qz``)."""
    height, longest = F.col("qy") / F.col("ey"), F.greatest("qx", "qy", "qz") / F.greatest("ex", "ey", "ez")
    q = lambda x: F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.where((F.col("ey") > 0) & (F.greatest("ex", "ey", "ez") > 0)).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), q(height).alias("__h"), q(longest).alias("__l"))
    names = [(c, tag) for c, tag in (("__h", "height"), ("__l", "edge"))]
    return out.select(kind, "n", *[F.col(c)[i].alias(f"{tag}_{part}") for c, tag in names for i, part in enumerate(("q1", "median", "q3"))])


def displaced_sets(before: DataFrame, after: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """Per group the objects of two settlings: in both, lost, new, and how many of the shared ones moved at least ``least`` and how far at most."""
    j = before.select(*keys, "id", *[F.col(c).alias(f"a{c}") for c in "xyz"]).join(after.select(*keys, "id", *[F.col(c).alias(f"b{c}") for c in "xyz"]), [*keys, "id"], "full")
    far = F.sqrt(sum((F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "xyz"), F.lit(0.0)))
    both = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    return j.groupBy(*keys).agg(F.count_if(both).alias("shared"), F.count_if(F.col("bx").isNull()).alias("lost"), F.count_if(F.col("ax").isNull()).alias("new"), F.count_if(both & (far >= least)).alias("moved"), F.max(F.when(both, far)).alias("farthest"))


def batch_summary(runs: DataFrame, ok: Column, cost: str, trusted: Column) -> DataFrame:
    """Successful runs, their median cost, total hours, and the pass rate of trusted verdicts."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), F.percentile(F.when(ok, F.col(cost)), F.lit(0.5)).alias("median_cost"), (F.sum(cost) / 3600).alias("hours"),
        (F.count_if(ok & trusted) / F.greatest(F.count_if(trusted), F.lit(1))).alias("trusted_pass_rate"),
    )


def variance_decomposition(rows: DataFrame, clip: str, value: str) -> DataFrame:
    """Share of the variance that lies between clips of two or more rows, by sums of squares."""
    g = rows.groupBy(clip).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss")).where("n >= 2")
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clips"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, total = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select("clips", "n", (between / total).alias("between_share"))


def half_binomial_tail(k: int, n: int) -> float:
    """P(X <= k) of n fair coins, as the incomplete beta function at one half by its continued fraction: a few dozen steps for any n."""
    if k >= n:
        return 1.0
    a, b = float(n - k), k + 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2))
    if a < b:  # the fraction converges fast below the mean only
        return 1.0 - half_binomial_tail(n - k - 1, n)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * 0.5 / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h / a


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact sign test; 1 without untied pairs."""
    n = wins + losses
    return min(1.0, 2.0 * half_binomial_tail(min(wins, losses), n)) if n else 1.0


def paired_tests(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Wins, losses and ties of paired values, and the two-sided exact sign test. One aggregate row is all that the driver sees."""
    counts = rows.agg(F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) < F.col(b)).alias("losses"), F.count_if(F.col(a) == F.col(b)).alias("ties"))
    row = counts.first()
    return counts.withColumn("p_value", F.lit(sign_test(row["wins"], row["losses"])))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The four cells of paired yes-or-no outcomes, and McNemar's exact test on the two that differ."""
    x, y = F.col(a), F.col(b)
    cells = rows.where(x.isNotNull() & y.isNotNull()).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    row = cells.first()
    return cells.withColumn("p_value", F.lit(sign_test(row["only_a"], row["only_b"])))


def dataset_profile(nodes: DataFrame, clip: str, motion: str, material: str, vocabulary: list[str], name: str) -> DataFrame:
    """Per clip: motion types, material forms, how many names are in the binding vocabulary."""
    return nodes.groupBy(clip).agg(
        F.array_sort(F.collect_set(motion)).alias("motion_types"), F.countDistinct(material).alias("material_forms"), F.count_if(F.lower(name).isin(*vocabulary)).alias("vocabulary_hits"), F.count(F.lit(1)).alias("nodes")
    )


def clip_aggregates(metrics: DataFrame, clip: str, columns: list[str]) -> DataFrame:
    """Means of object metrics per clip, six places."""
    return metrics.groupBy(clip).agg(F.count(F.lit(1)).alias("objects"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns])


def arms_side_by_side(pooled: DataFrame, arm: str, arms: list[str], metrics: list[str]) -> DataFrame:
    """A row per metric, a column per arm."""
    long = pooled.select(arm, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(arm, "x.*")
    return long.groupBy("metric").agg(*[F.max(F.when(F.col(arm) == a, F.col("value"))).alias(a) for a in arms])

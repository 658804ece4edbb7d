"""Matching, evaluation and statistics over order lines, orders, events and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sceneloom.functions import columns as C
from sceneloom.functions.columns import r6
from sceneloom.operators import evaluation as E
from sceneloom.operators import matching as M
from sceneloom.plans.adapters import NODES, PREDICTIONS, STATES, nodes, predictions, states, table
from sceneloom.plans.registry import query

LIMIT = 0.15
RATIO = "list_transform(list_reverse_sort([{0}ex, {0}ey, {0}ez]), lambda e: e / greatest({0}ex, {0}ey, {0}ez))"
EVALUATED = PREDICTIONS + f""",
joined AS (SELECT g.clip, g.node, g.class AS gc, p.class AS pc, {RATIO.format('g.')} AS a, {RATIO.format('p.')} AS b, sqrt((p.px - g.px) ** 2 + (p.py - g.py) ** 2 + (p.pz - g.pz) ** 2) AS distance FROM nodes g LEFT JOIN predictions p USING (clip, node)),
evaluated AS (SELECT clip, node, distance, coalesce(distance <= {LIMIT}, false) AS found, gc = pc AS class_ok, (abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 3 AS shape_error FROM joined),
runs AS (SELECT clip, n_gt, coalesce(n_pred, 0) AS n_pred, n_matched, med, n_matched / n_gt AS recall, CASE WHEN n_pred > 0 THEN n_matched / n_pred END AS precision FROM
  (SELECT clip, count(*) AS n_gt, count(*) FILTER (WHERE found) AS n_matched, quantile_cont(CASE WHEN found THEN distance END, 0.5) AS med FROM evaluated GROUP BY clip) LEFT JOIN (SELECT clip, count(*) AS n_pred FROM predictions GROUP BY clip) USING (clip))"""


def _evaluated(spark, d):
    g = nodes(spark, d).select("clip", "node", "class", "px", "py", "pz", F.array("ex", "ey", "ez").alias("a"))
    p = predictions(spark, d)
    q = p.select("clip", "node", F.col("class").alias("pc"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("pz").alias("qz"), F.array("ex", "ey", "ez").alias("b"))
    far = F.sqrt(F.expr("pow(qx - px, 2) + pow(qy - py, 2) + pow(qz - pz, 2)"))
    e = E.evaluate_pairs(g, q, ["clip", "node"], far, LIMIT).withColumn("class_ok", F.col("class") == F.col("pc")).withColumn("shape_error", C.shape_error(F.col("a"), F.col("b")))
    return e, p


@query(f"""WITH {EVALUATED} SELECT clip, n_gt, n_pred, n_matched, round(med, 6) AS median_error, round(recall, 6) AS recall, round(precision, 6) AS precision FROM runs""")
def a1_evaluate_runs(spark, d):
    e, p = _evaluated(spark, d)
    out = E.run_summary(e, p, "clip")
    return out.select("clip", "n_gt", "n_pred", "n_matched", *[r6(F.col(c)).alias(c) for c in ("median_error", "recall", "precision")])


POOLED = EVALUATED + """, configs AS (SELECT o_orderkey AS clip, o_orderpriority AS config FROM orders), eo AS (SELECT * FROM evaluated JOIN configs USING (clip)), er AS (SELECT * FROM runs JOIN configs USING (clip)),
pooled AS (SELECT * FROM (SELECT config, count(*) AS n_objects, count(*) FILTER (WHERE found) AS n_found, round(avg(class_ok::INT), 6) AS class_accuracy, round(quantile_cont(CASE WHEN found THEN distance END, 0.5), 6) AS median_error,
  round(quantile_cont(CASE WHEN found THEN shape_error END, 0.5), 6) AS median_shape_error FROM eo GROUP BY config)
  LEFT JOIN (SELECT config, count(*) AS n_runs, round(avg(recall), 6) AS mean_recall, round(coalesce(stddev_samp(recall), 0), 6) AS std_recall, round(avg(precision), 6) AS mean_precision FROM er GROUP BY config) USING (config))"""


def _pooled(spark, d):
    e, p = _evaluated(spark, d)
    configs = table(spark, d, "orders").select(F.col("o_orderkey").alias("clip"), F.col("o_orderpriority").alias("config"))
    runs = E.run_summary(e, p, "clip").join(configs, "clip")
    out = E.pool_report(e.join(configs, "clip"), runs, "config")
    return out.select("config", "n_objects", "n_found", "n_runs", *[r6(F.col(c)).alias(c) for c in ("class_accuracy", "median_error", "median_shape_error", "mean_recall", "std_recall", "mean_precision")])


@query(f"WITH {POOLED} SELECT * FROM pooled")
def a2_pool_report(spark, d):
    """The flagship: how many truths each configuration found, how far off they are, how often the shape is right."""
    return _pooled(spark, d)


@query(f"""WITH {POOLED}, c AS (SELECT config, printf('%.3f', median_error) AS median_error, printf('%.3f', mean_recall) AS mean_recall FROM pooled) SELECT config, median_error, mean_recall, '| ' || config || ' | ' || median_error || ' | ' || mean_recall || ' |' AS line FROM c""")
def a3_report_table(spark, d):
    return E.report_table(_pooled(spark, d), "config", {"median_error": 3, "mean_recall": 3})


QUALITY = f"""{STATES}, obs AS (SELECT clip, instance AS object_id, floor(t / 86400)::BIGINT AS frame, t, x / 100 AS visible, CASE WHEN y < 20 THEN NULL ELSE y END AS depth FROM states),
fr AS (SELECT clip, frame, min(t) AS t FROM obs GROUP BY ALL), pos AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS pos FROM fr), cl AS (SELECT clip, count(*) AS registered, max(t) - min(t) AS duration FROM fr GROUP BY clip),
o AS (SELECT clip, object_id, count(*) AS observations, avg((depth IS NOT NULL)::INT) AS depth_measured, avg(visible) AS mean_visible, avg((visible <= 0.3)::INT) AS severe_occlusion, max(t) - min(t) AS span FROM obs GROUP BY ALL),
s AS (SELECT DISTINCT clip, object_id, frame, pos FROM obs JOIN pos USING (clip, frame)), gp AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY clip, object_id ORDER BY pos) - 1, 0) AS gap FROM s),
g AS (SELECT clip, object_id, count(*) AS frames_seen, count(*) FILTER (WHERE gap > 0) AS gap_count, max(gap) AS max_gap FROM gp GROUP BY ALL),
q AS (SELECT o.*, frames_seen, gap_count, max_gap, frames_seen / registered AS coverage, CASE WHEN duration > 0 THEN least(span / duration, 1) ELSE 0 END AS span_ratio FROM o JOIN g USING (clip, object_id) JOIN cl USING (clip))"""


def _quality(spark, d):
    s = states(spark, d)
    o = s.select("clip", F.col("instance").alias("object_id"), F.floor(F.col("t") / 86400).cast("long").alias("frame"), "t", (F.col("x") / 100).alias("visible"), F.when(F.col("y") >= 20, F.col("y")).alias("depth"))
    return E.quality_metrics(o, o.groupBy("clip", "frame").agg(F.min("t").alias("t")))


@query(f"WITH {QUALITY} SELECT clip, object_id, observations, frames_seen, gap_count, max_gap, round(depth_measured, 6) AS depth_measured, round(mean_visible, 6) AS mean_visible, round(severe_occlusion, 6) AS severe_occlusion, round(coverage, 6) AS coverage, round(span_ratio, 6) AS span_ratio FROM q")
def a4_evidence_quality(spark, d):
    q = _quality(spark, d)
    return q.select("clip", "object_id", "observations", "frames_seen", "gap_count", F.col("max_gap").cast("long"), *[r6(F.col(c)).alias(c) for c in ("depth_measured", "mean_visible", "severe_occlusion", "coverage", "span_ratio")])


@query(f"WITH {QUALITY} SELECT clip, count(*) AS objects, CASE WHEN bool_or(coverage < 0.08) THEN 'block' WHEN bool_or(max_gap > 12 OR mean_visible < 0.2) THEN 'warn' ELSE 'proceed' END AS decision FROM q GROUP BY clip")
def v4_quality_gate(spark, d):
    return E.quality_gate(_quality(spark, d), "clip", F.col("coverage") < 0.08, (F.col("max_gap") > 12) | (F.col("mean_visible") < 0.2))


@query(f"""WITH {STATES}, c AS (SELECT clip, instance, CASE WHEN y < 3 THEN NULL ELSE x END AS conf FROM states), w AS (SELECT *, sum(conf) OVER h AS s, count(*) OVER h AS n, count(conf) OVER h AS k FROM c WINDOW h AS (PARTITION BY clip, instance)),
e AS (SELECT clip, instance, n, k, s, -sum(CASE WHEN conf / s > 0 THEN conf / s * ln(conf / s) END) AS e FROM w GROUP BY ALL)
SELECT clip, round(max(CASE WHEN k = n AND n >= 2 AND s > 0 THEN e / ln(n) END), 6) AS entropy, bool_or(NOT coalesce(k = n AND n >= 2 AND s > 0, false)) AS has_unknown FROM e GROUP BY clip""")
def a5_identity_entropy(spark, d):
    c = states(spark, d).select("clip", "instance", F.when(F.col("y") >= 3, F.col("x")).alias("conf"))
    out = E.identity_entropy(c, ["clip"], "instance", "conf")
    return out.withColumn("entropy", r6(F.col("entropy"))).withColumn("has_unknown", F.coalesce("has_unknown", F.lit(True)))


@query(f"""WITH {STATES}, r AS (SELECT clip, instance, x, y, row_number() OVER (PARTITION BY clip, instance ORDER BY x DESC, y) AS r FROM states)
SELECT clip, instance, round(max(x) FILTER (WHERE r = 1), 6) AS best, round(max(x) FILTER (WHERE r = 1) - max(x) FILTER (WHERE r = 2), 6) AS margin FROM r GROUP BY ALL""")
def a6_motion_support(spark, d):
    return E.motion_support(states(spark, d), ["clip", "instance"], "x", "y").select("clip", "instance", r6(F.col("best")).alias("best"), r6(F.col("margin")).alias("margin"))


@query(f"""WITH {PREDICTIONS}, v AS (SELECT clip, abs(ln(p.ex / g.ex)) AS v FROM nodes g JOIN predictions p USING (clip, node) WHERE p.ex > 0 AND g.ex > 0)
SELECT clip, count(*) AS n, round(list_sort(list(v))[len(list(v)) // 2 + 1], 6) AS log_size_error, count(*) FILTER (WHERE v > {math.log(2)!r}) AS outliers FROM v GROUP BY clip""")
def a7_fidelity(spark, d):
    j = nodes(spark, d).select("clip", "node", F.col("ex").alias("o")).join(predictions(spark, d).select("clip", "node", F.col("ex").alias("w")), ["clip", "node"])
    return E.fidelity(j, ["clip"], "w", "o").withColumn("log_size_error", r6(F.col("log_size_error")))


@query(f"""WITH {NODES} SELECT class, round(avg((node % 2 = 0)::INT), 6) AS manipulable, round(avg((node % 5 IN (0, 1))::INT), 6) AS scripted, round(avg((node % 5 IN (2, 3))::INT), 6) AS articulated, round(avg((node % 5 = 4)::INT), 6) AS simulated FROM nodes GROUP BY class""")
def a7_interactivity(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("trajectory", "periodic", "revolute", "prismatic", "dynamic")])
    n = nodes(spark, d).withColumn("motion", kinds[F.expr("cast(node % 5 AS int)")]).withColumn("grab", F.when(F.col("node") % 2 == 0, "free").otherwise("none"))
    out = E.interactivity(n, ["class"], "motion", "grab")
    return out.select("class", *[r6(F.col(c)).alias(c) for c in ("manipulable", "scripted", "articulated", "simulated")])


@query(f"""WITH {STATES} SELECT instance AS mode, count(*) AS n, round(avg((x / 50 >= 0.5 AND y / 200 <= 0.25 AND x / 100 < 0.5)::INT), 6) AS success, round(list_sort(list(y / 200))[(len(list(y)) - 1) // 2 + 1], 6) AS follow_error FROM states GROUP BY instance""")
def a8_interaction_summary(spark, d):
    p = states(spark, d).select(F.col("instance").alias("mode"), (F.col("x") / 50).alias("lift"), (F.col("y") / 200).alias("follow"), (F.col("x") / 100).alias("speed"))
    out = E.interaction_summary(p, "mode", "lift", "follow", "speed")
    return out.select("mode", "n", r6(F.col("success")).alias("success"), r6(F.col("follow_error")).alias("follow_error"))


SCORED = "scored AS (SELECT doc_id, quality = 1 AS hit, toxic, n_chars::DOUBLE AS score, lang, source FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    return j.select("doc_id", (F.col("quality") == 1).alias("hit"), "toxic", F.col("n_chars").cast("double").alias("score"), "lang", "source")


@query(f"""WITH {PREDICTIONS}, t AS (SELECT g.class AS t, CASE WHEN p.class IN ('X') THEN 'N' ELSE p.class END AS g FROM nodes g JOIN predictions p USING (clip, node))
SELECT count(*) AS n, round(avg((t = g)::INT), 6) AS accuracy, round(avg((t = 'N')::INT), 6) AS always_rest, round(count(*) FILTER (WHERE t <> 'N' AND g <> 'N') / greatest(count(*) FILTER (WHERE g <> 'N'), 1), 6) AS moving_precision,
  round(count(*) FILTER (WHERE t <> 'N' AND g <> 'N') / greatest(count(*) FILTER (WHERE t <> 'N'), 1), 6) AS moving_recall, round(avg((t <> 'N')::INT), 6) AS base_rate FROM t""")
def a9_confusion_rescore(spark, d):
    j = nodes(spark, d).select("clip", "node", F.col("class").alias("t")).join(predictions(spark, d).select("clip", "node", F.col("class").alias("g")), ["clip", "node"])
    out = E.confusion_rescore(E.confusion(j, "t", "g"), "t", "g", ["X"], "N")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "always_rest", "moving_precision", "moving_recall", "base_rate")])


@query(f"""WITH {SCORED}, t AS (SELECT * FROM scored, (SELECT unnest([100, 500, 1000, 2000, 5000]::DOUBLE[]) AS threshold)),
s AS (SELECT threshold, count(*) FILTER (WHERE score <= threshold AND hit) AS tp, count(*) FILTER (WHERE score <= threshold AND NOT hit) AS fp, count(*) FILTER (WHERE score > threshold AND hit) AS fn, count(*) FILTER (WHERE score > threshold AND NOT hit) AS tn FROM t GROUP BY threshold),
r AS (SELECT *, tp / greatest(tp + fn, 1) AS tpr, fp / greatest(fp + tn, 1) AS fpr FROM s)
SELECT threshold, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, row_number() OVER (ORDER BY round(tpr - fpr, 9) DESC, threshold) = 1 AS best FROM r""")
def a10_threshold_sweep(spark, d):
    out = E.threshold_sweep(_scored(spark, d), "score", "hit", [100, 500, 1000, 2000, 5000])
    return out.select("threshold", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("tpr", "fpr", "f1")], "best")


@query(f"""WITH {SCORED}, l AS (SELECT hit, 'score' AS attribute, score AS value FROM scored UNION ALL SELECT hit, 'toxic', toxic::DOUBLE FROM scored), c AS (SELECT attribute, unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9])) AS threshold FROM l GROUP BY attribute),
t AS (SELECT l.attribute, threshold, direction, hit, CASE WHEN direction = 'above' THEN value >= threshold ELSE value <= threshold END AS yes FROM l JOIN (SELECT DISTINCT * FROM c) USING (attribute), (SELECT unnest(['above', 'below']) AS direction)),
g AS (SELECT attribute, threshold, direction, count(*) FILTER (WHERE yes AND hit) / greatest(count(*) FILTER (WHERE hit), 1) + count(*) FILTER (WHERE NOT yes AND NOT hit) / greatest(count(*) FILTER (WHERE NOT hit), 1) - 1 AS gain FROM t GROUP BY ALL)
SELECT attribute, round(threshold, 6) AS threshold, direction, round(gain, 6) + 0.0::DOUBLE AS gain FROM g QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY round(gain, 9) DESC, threshold, direction) = 1""")
def a11_best_split(spark, d):
    out = E.best_split(_scored(spark, d), ["score", "toxic"], "hit")
    return out.select("attribute", r6(F.col("threshold")).alias("threshold"), "direction", r6(F.col("gain")).alias("gain"))


@query(f"""WITH {STATES}, r AS (SELECT clip, x, y, rank() OVER (PARTITION BY clip ORDER BY x) + (count(*) OVER (PARTITION BY clip, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY clip ORDER BY y) + (count(*) OVER (PARTITION BY clip, y) - 1) / 2 AS ry FROM states)
SELECT clip, count(*) AS n, round(CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END, 6) AS spearman, CASE WHEN count(*) < 3 THEN 'too_few' WHEN count(DISTINCT x) < 2 OR count(DISTINCT y) < 2 THEN 'constant' ELSE 'available' END AS status FROM r GROUP BY clip""")
def a12_rank_agreement(spark, d):
    return E.rank_agreement(states(spark, d), "clip", "x", "y").withColumn("spearman", r6(F.col("spearman")))


@query(f"""WITH {NODES}, v AS (SELECT 'drop' AS variant, clip, node, px FROM nodes WHERE node % 4 <> 0 UNION ALL SELECT 'shift', clip, node, px + 0.3::DOUBLE FROM nodes UNION ALL SELECT 'shift_one', clip, node, px + CASE WHEN node = 1 THEN 0.3::DOUBLE ELSE 0 END FROM nodes)
SELECT variant, count(v.px) AS kept, count(*) AS truths, round(avg(abs(v.px - n.px)), 6) AS error, round(count(v.px) / count(*), 6) AS recall FROM nodes n CROSS JOIN (SELECT unnest(['drop', 'shift', 'shift_one']) AS variant) k LEFT JOIN v USING (variant, clip, node) GROUP BY variant""")
def a13_perturb_sensitivity(spark, d):
    n = nodes(spark, d).select("clip", "node", "px")
    v = E.perturb(n, {"shift": {"px": F.col("px") + 0.3}, "shift_one": {"px": F.expr("px + CASE WHEN node = 1 THEN 0.3D ELSE 0 END")}}, {"drop": F.col("node") % 4 == 0})
    truth = n.withColumnRenamed("px", "g").withColumn("variant", F.explode(F.array(F.lit("drop"), F.lit("shift"), F.lit("shift_one"))))
    j = truth.join(v, ["variant", "clip", "node"], "left")
    return j.groupBy("variant").agg(F.count("px").alias("kept"), F.count(F.lit(1)).alias("truths"), r6(F.avg(F.abs(F.col("px") - F.col("g")))).alias("error"), r6(F.count("px") / F.count(F.lit(1))).alias("recall"))


@query(f"""WITH {PREDICTIONS}, q AS (SELECT g.class, count(*) AS n, quantile_cont(g.ex, [0.25, 0.5, 0.75]) AS t, quantile_cont(p.ex, [0.25, 0.5, 0.75]) AS p FROM nodes g JOIN predictions p USING (clip, node) GROUP BY g.class)
SELECT class, n, round(p[2] / t[2], 6) AS median_ratio, round((p[3] - p[1]) / (t[3] - t[1]), 6) AS spread_ratio FROM q""")
def a14_scale_by_framing(spark, d):
    j = nodes(spark, d).select("clip", "node", "class", F.col("ex").alias("t")).join(predictions(spark, d).select("clip", "node", F.col("ex").alias("p")), ["clip", "node"])
    out = E.scale_by_framing(j.withColumnRenamed("t", "te").withColumnRenamed("p", "pe"), ["class"], "te", "pe")
    return out.withColumn("median_ratio", r6(F.col("median_ratio"))).withColumn("spread_ratio", r6(F.col("spread_ratio")))


@query(f"WITH {NODES}, q AS (SELECT grp, count(*) AS n, quantile_cont(ey / greatest(ex, ez), [0.25, 0.5, 0.75]) AS q FROM nodes GROUP BY grp) SELECT grp, n, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3 FROM q")
def a15_structure_signal(spark, d):
    out = E.structure_signal(nodes(spark, d), "grp")
    return out.select("grp", "n", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")])


@query("""SELECT count(*) AS runs, count(*) FILTER (WHERE o_orderstatus <> 'F') AS succeeded, round(quantile_cont(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END, 0.5), 6) AS median_cost, round(sum(o_totalprice) / 3600, 4) AS hours,
  round(count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_custkey % 3 <> 0) / greatest(count(*) FILTER (WHERE o_custkey % 3 <> 0), 1), 6) AS trusted_pass_rate FROM orders""")
def a16_batch_summary(spark, d):
    out = E.batch_summary(table(spark, d, "orders"), F.col("o_orderstatus") != "F", "o_totalprice", F.col("o_custkey") % 3 != 0)
    return out.select("runs", "succeeded", r6(F.col("median_cost")).alias("median_cost"), F.round("hours", 4).alias("hours"), r6(F.col("trusted_pass_rate")).alias("trusted_pass_rate"))


@query(f"""WITH {NODES}, g AS (SELECT clip, count(*) AS n, sum(ln(ex)) AS s, sum(ln(ex) * ln(ex)) AS ss FROM nodes GROUP BY clip HAVING count(*) >= 2)
SELECT count(*) AS clips, sum(n)::BIGINT AS n, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS between_share FROM g""")
def a17_variance_decomposition(spark, d):
    return E.variance_decomposition(nodes(spark, d).withColumn("v", F.ln("ex")), "clip", "v").withColumn("between_share", r6(F.col("between_share")))


def _sign_sql(a: str, b: str) -> str:
    """Two-sided sign test of two counts, summed term by term."""
    n = f"({a} + {b})"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    return f"CASE WHEN {n} = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least({a}, {b}) + 1), lambda i: {term}))) END::DOUBLE"


#: Pairs that are close enough to each other for the test to say something.
PAIRED = "SELECT x, CASE WHEN event_id % 3 = 0 THEN x WHEN event_id % 40 < 21 THEN x + 1 ELSE x - 1 END AS other FROM states"


@query(f"""WITH {STATES}, p AS ({PAIRED}), c AS (SELECT count(*) FILTER (WHERE x > other) AS wins, count(*) FILTER (WHERE x < other) AS losses, count(*) FILTER (WHERE x = other) AS ties FROM p)
SELECT *, round({_sign_sql('wins', 'losses')}, 6) AS p_value FROM c""")
def a17_paired_tests(spark, d):
    s = states(spark, d).withColumn("other", F.expr("CASE WHEN event_id % 3 = 0 THEN x WHEN event_id % 40 < 21 THEN x + 1 ELSE x - 1 END"))
    return E.paired_tests(s, "x", "other").withColumn("p_value", r6(F.col("p_value")))


@query(f"""WITH {STATES}, o AS (SELECT x > 50 AS a, x + event_id % 9 - 4 > 50 AS b FROM states), c AS (SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM o)
SELECT *, round({_sign_sql('only_a', 'only_b')}, 5) AS p_value FROM c""")
def a17_mcnemar(spark, d):
    s = states(spark, d).select((F.col("x") > 50).alias("a"), (F.col("x") + F.col("event_id") % 9 - 4 > 50).alias("b"))
    return E.mcnemar(s, "a", "b").withColumn("p_value", F.round("p_value", 5))


@query(f"""WITH {NODES} SELECT clip, array_to_string(list_sort(list(DISTINCT 'm' || (node % 3))), ',') AS motion_types, count(DISTINCT class) AS material_forms, count(*) FILTER (WHERE lower(class) IN ('a', 'r')) AS vocabulary_hits, count(*) AS nodes FROM nodes GROUP BY clip""")
def a18_dataset_profile(spark, d):
    n = nodes(spark, d).withColumn("motion", F.concat(F.lit("m"), F.expr("cast(node % 3 AS string)")))
    return E.dataset_profile(n, "clip", "motion", "class", ["a", "r"], "class").withColumn("motion_types", F.array_join("motion_types", ","))


DETECTIONS = f"""{STATES}, det AS (SELECT clip, event_id AS detection_id, floor(t / 3600)::BIGINT AS frame, instance AS label, x / 100 AS score, x AS x1, y AS y1, x + 30 AS x2, y + 40 AS y2 FROM states)"""


def _detections(spark, d):
    s = states(spark, d)
    return s.select("clip", F.col("event_id").alias("detection_id"), F.floor(F.col("t") / 3600).cast("int").alias("frame"), F.col("instance").alias("label"), (F.col("x") / 100).alias("score"), F.col("x").alias("x1"), F.col("y").alias("y1"),
                    (F.col("x") + 30).alias("x2"), (F.col("y") + 40).alias("y2"))


@query(f"""WITH RECURSIVE {DETECTIONS}, s AS (SELECT clip, frame // 24 AS frame, detection_id, row(x1, y1, x2, y2)::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) AS box, row_number() OVER (PARTITION BY clip, frame // 24 ORDER BY -score, label, x1, y1, x2, y2, detection_id) AS k
  FROM det WHERE (x2 - x1) * (y2 - y1) / 40000 BETWEEN 0.0005 AND 0.9),
walk AS (SELECT clip, frame, k, detection_id, true AS kept, [box] AS boxes FROM s WHERE k = 1
  UNION ALL SELECT clip, frame, k, detection_id, kept, CASE WHEN kept THEN list_append(boxes, box) ELSE boxes END FROM (
    SELECT s.clip, s.frame, s.k, s.detection_id, s.box, w.boxes, len(w.boxes) < 100 AND len(list_filter(w.boxes, lambda b: greatest(least(b.x2, s.box.x2) - greatest(b.x1, s.box.x1), 0) * greatest(least(b.y2, s.box.y2) - greatest(b.y1, s.box.y1), 0)
      > 0.3::DOUBLE * (2400 - greatest(least(b.x2, s.box.x2) - greatest(b.x1, s.box.x1), 0) * greatest(least(b.y2, s.box.y2) - greatest(b.y1, s.box.y1), 0) ) ) ) = 0 AS kept
    FROM walk w JOIN s ON s.clip = w.clip AND s.frame = w.frame AND s.k = w.k + 1))
SELECT clip, frame, detection_id FROM walk WHERE kept""")
def j1_nms(spark, d):
    frames = _detections(spark, d).withColumn("frame", F.floor(F.col("frame") / 24))
    return M.nms(frames, ["clip", "frame"], 40_000.0, 0.3)


_W = M.AssociationConfig().weights


@query(f"""WITH {DETECTIONS}, p AS (SELECT a.clip, a.detection_id, b.detection_id AS n_detection_id, b.frame - a.frame AS gap, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2) / 50 AS apart FROM det a JOIN det b ON a.clip = b.clip AND a.label = b.label AND b.frame > a.frame AND b.frame - a.frame <= 24)
SELECT clip, detection_id, n_detection_id, round(({_W['class']} + {_W['bbox_iou']} * i / (2400 - i) + {_W['time']} * exp(-gap / 12::DOUBLE)) / {_W['class'] + _W['bbox_iou'] + _W['time']!r}, 5) AS score FROM p WHERE apart <= 2.5""")
def j2_pair_score(spark, d):
    return M.pair_scores(_detections(spark, d), ["clip"]).withColumn("score", F.round("score", 5))


@query(None)
def j3_associate(spark, d):
    return M.associate(_detections(spark, d)).select("clip", "detection_id", "frame", "track_id", "code", r6(F.col("score")).alias("score"))


def _costs(spark, d, limit):
    g = nodes(spark, d).select("clip", F.col("node").alias("gt"), F.col("px").alias("gx"), F.col("py").alias("gy"), F.col("pz").alias("gz"))
    p = predictions(spark, d).select("clip", F.col("node").alias("pred"), "px", "py", "pz")
    j = g.join(p, "clip").withColumn("cost", F.sqrt(F.expr("pow(gx - px, 2) + pow(gy - py, 2) + pow(gz - pz, 2)")))
    return j.where(F.col("cost") <= limit).select("clip", "gt", "pred", "cost")


@query(None)
def j4_match_objects(spark, d):
    return M.match_costs(_costs(spark, d, 5.0), ["clip"], 5.0).withColumn("cost", r6(F.col("cost")))


@query(f"""WITH RECURSIVE {PREDICTIONS}, c AS (SELECT g.clip, g.node AS gt, p.node AS pred, sqrt((g.px - p.px) ** 2 + (g.py - p.py) ** 2 + (g.pz - p.pz) ** 2) AS cost FROM nodes g JOIN predictions p USING (clip)),
s AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY cost, gt, pred) AS k FROM c WHERE cost <= 5),
walk AS (SELECT clip, k, gt, pred, cost, true AS kept, [gt] AS gts, [pred] AS preds FROM s WHERE k = 1
  UNION ALL SELECT clip, k, gt, pred, cost, kept, CASE WHEN kept THEN list_append(gts, gt) ELSE gts END, CASE WHEN kept THEN list_append(preds, pred) ELSE preds END FROM (
    SELECT s.*, w.gts, w.preds, NOT list_contains(w.gts, s.gt) AND NOT list_contains(w.preds, s.pred) AS kept FROM walk w JOIN s ON s.clip = w.clip AND s.k = w.k + 1))
SELECT clip, gt, pred, round(cost, 6) AS cost FROM walk WHERE kept""")
def j5_greedy_match(spark, d):
    return M.match_costs(_costs(spark, d, 5.0), ["clip"], 5.0, greedy=True).withColumn("cost", r6(F.col("cost")))


@query(None)
def j6_coarse_gauge(spark, d):
    side = lambda df, s: df.select("clip", F.lit(s).alias("side"), F.col("node").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    points = side(nodes(spark, d), "gt").unionAll(side(predictions(spark, d), "pred"))
    return M.coarse_gauge(points, ["clip"], 0.5).select("clip", "inliers", r6(F.col("cost")).alias("cost"), "yaw_deg", r6(F.col("tx")).alias("tx"), r6(F.col("tz")).alias("tz"))


@query(f"""WITH {PREDICTIONS}, m AS (SELECT clip, count(*) AS pairs, avg(g.px) AS mgx, avg(g.pz) AS mgz, avg(p.px) AS mpx, avg(p.pz) AS mpz, covar_pop(g.px, p.px) AS xx, covar_pop(g.pz, p.pz) AS zz, covar_pop(g.px, p.pz) AS xz, covar_pop(g.pz, p.px) AS zx FROM nodes g JOIN predictions p USING (clip, node) GROUP BY clip),
y AS (SELECT *, CASE WHEN pairs > 1 THEN atan2(xz - zx, xx + zz) ELSE 0 END AS yaw FROM m)
SELECT clip, pairs, round(degrees(yaw), 4) + 0.0::DOUBLE AS yaw_deg, round(mgx - (cos(yaw) * mpx + sin(yaw) * mpz), 4) + 0.0::DOUBLE AS tx FROM y WHERE pairs >= 3""")
def j6_fine_gauge(spark, d):
    g = nodes(spark, d).select("clip", "node", F.col("px").alias("gx"), F.col("pz").alias("gz"))
    p = predictions(spark, d).select("clip", "node", "px", "pz")
    out = M.fine_gauge(g.join(p, ["clip", "node"]), ["clip"]).where("pairs >= 3")
    return out.select("clip", "pairs", (F.round("yaw_deg", 4) + F.lit(0.0)).alias("yaw_deg"), (F.round("tx", 4) + F.lit(0.0)).alias("tx"))


@query(f"""WITH {NODES}, e AS (SELECT DISTINCT clip, CASE node % 3 WHEN 0 THEN class ELSE class || ' ' || (node // 3) END AS id FROM nodes), p AS (SELECT DISTINCT clip, CASE node % 2 WHEN 0 THEN class ELSE class || '_' || (node // 3) END AS id FROM nodes),
k AS (SELECT clip, id AS evidence_id, 0 AS r, id AS program_id FROM e UNION ALL SELECT clip, id, 1, replace(id, ' ', '_') FROM e UNION ALL SELECT clip, id, 2, regexp_replace(replace(id, ' ', '_'), '_[0-9]+$', '') FROM e),
b AS (SELECT k.clip, evidence_id, program_id FROM k JOIN p ON k.clip = p.clip AND k.program_id = p.id QUALIFY row_number() OVER (PARTITION BY k.clip, evidence_id ORDER BY r, program_id) = 1)
SELECT status, count(*) AS n FROM (SELECT 'resolved' AS status FROM b UNION ALL SELECT 'missing' FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.clip = e.clip AND b.evidence_id = e.id) UNION ALL SELECT 'extra' FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.clip = p.clip AND b.program_id = p.id)) GROUP BY status""")
def j7_resolve_ids(spark, d):
    n = nodes(spark, d)
    e = n.select("clip", F.expr("CASE node % 3 WHEN 0 THEN class ELSE concat(class, ' ', node div 3) END").alias("id")).distinct()
    p = n.select("clip", F.expr("CASE node % 2 WHEN 0 THEN class ELSE concat(class, '_', node div 3) END").alias("id")).distinct()
    return M.resolve_ids(e, p).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


NEAREST = PREDICTIONS + """, near AS (SELECT p.clip, p.node, p.class AS pc, g.node AS truth, g.class AS gc, abs(p.px - g.px) + abs(p.pz - g.pz) AS dist FROM predictions p LEFT JOIN nodes g ON g.clip = p.clip AND g.grp = 'static' QUALIFY row_number() OVER (PARTITION BY p.clip, p.node ORDER BY dist NULLS LAST, g.node) = 1)"""


def _nearest(spark, d):
    truths = nodes(spark, d).where("grp = 'static'").select("clip", F.col("node").alias("truth"), F.col("class").alias("gc"), F.col("px").alias("gx"), F.col("pz").alias("gz"))
    p = predictions(spark, d).select("clip", "node", F.col("class").alias("pc"), "px", "pz")
    return M.nearest(p, truths, ["clip"], F.expr("abs(px - gx) + abs(pz - gz)"), "node", "truth")


@query(f"WITH {NEAREST} SELECT CASE WHEN dist <= 1 AND pc = gc THEN 'compatible' WHEN dist <= 1 THEN 'other_class' ELSE 'orphan' END AS kind, count(*) AS n FROM near GROUP BY kind")
def j8_attribute_false_positives(spark, d):
    near = F.col("distance") <= 1
    return _nearest(spark, d).groupBy(F.when(near & (F.col("pc") == F.col("gc")), "compatible").when(near, "other_class").otherwise("orphan").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PREDICTIONS}, m AS (SELECT g.clip, g.node, p.node IS NOT NULL AS matched FROM nodes g LEFT JOIN predictions p USING (clip, node)), k AS (SELECT m.clip, m.node, matched, p.node AS cand, abs(g.px - p.px) AS dist FROM m JOIN nodes g USING (clip, node) LEFT JOIN predictions p ON p.clip = m.clip QUALIFY row_number() OVER (PARTITION BY m.clip, m.node ORDER BY dist NULLS LAST, p.node) = 1)
SELECT CASE WHEN matched THEN 'matched' WHEN dist IS NULL THEN 'absent' WHEN dist <= 1 THEN 'occupied' WHEN dist <= 4 THEN 'displaced' ELSE 'absent' END AS fate, count(*) AS n FROM k GROUP BY fate""")
def j9_decompose_misses(spark, d):
    p = predictions(spark, d).select("clip", F.col("node").alias("cand"), F.col("px").alias("cx"))
    g = nodes(spark, d).select("clip", "node", "px").join(p.select("clip", F.col("cand").alias("node"), F.lit(True).alias("matched")), ["clip", "node"], "left")
    out = M.nearest(g.withColumn("matched", F.coalesce("matched", F.lit(False))), p, ["clip"], F.abs(F.col("px") - F.col("cx")), "node", "cand")
    return out.groupBy(M.attribute_misses(F.col("distance"), F.col("matched"), F.lit(True), 1.0).alias("fate")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NEAREST} SELECT clip, truth, count(*) AS members FROM near WHERE dist <= 5 GROUP BY ALL HAVING count(*) >= 2")
def j10_group_fragments(spark, d):
    assigned = _nearest(spark, d).withColumn("truth", F.when(F.col("distance") <= 5, F.col("truth")))
    return M.group_fragments(assigned, ["clip"], "truth")


@query(f"""WITH {PREDICTIONS} SELECT clip, count(*) AS objects, round(quantile_cont(sqrt((g.px - p.px) ** 2 + (g.pz - p.pz) ** 2), 0.5), 6) AS median_drift, round(quantile_cont(abs(g.ey - p.ez), 0.5), 6) AS median_colour FROM nodes g JOIN predictions p USING (clip, node) GROUP BY clip""")
def j11_decoupling(spark, d):
    b = nodes(spark, d).select("clip", "node", F.col("px").alias("x"), F.col("pz").alias("z"), F.col("ey").alias("colour"))
    v = predictions(spark, d).select("clip", "node", F.col("px").alias("vx"), F.col("pz").alias("vz"), F.col("ez").alias("vcolour"))
    out = M.decoupling(b, v, ["clip", "node"])
    return out.select("clip", "objects", r6(F.col("median_drift")).alias("median_drift"), r6(F.col("median_colour")).alias("median_colour"))


@query(f"""WITH {NODES}, h AS (SELECT clip, CASE WHEN node % 4 = 0 THEN NULL ELSE class || (node % 5) END AS ref FROM nodes), o AS (SELECT DISTINCT clip, class || (node % 3) AS ref FROM nodes)
SELECT count(*) AS hypotheses, count(o.ref) AS kept, count(*) FILTER (WHERE h.ref IS NOT NULL AND o.ref IS NULL) AS dropped FROM h LEFT JOIN o ON h.clip = o.clip AND h.ref = o.ref""")
def j12_identity_refs(spark, d):
    n = nodes(spark, d)
    h = n.select("clip", F.expr("CASE WHEN node % 4 = 0 THEN NULL ELSE concat(class, node % 5) END").alias("ref"))
    o = n.select("clip", F.expr("concat(class, node % 3)").alias("object_id")).distinct()
    return M.identity_refs(h, o).agg(F.count(F.lit(1)).alias("hypotheses"), F.count("ref").alias("kept"), F.count_if("dropped").alias("dropped"))


@query(f"""WITH {NODES}, b AS (SELECT clip, class AS object_id, count(*) AS n, min(py) AS py, min(ey) AS ey FROM nodes GROUP BY ALL), p AS (SELECT clip, count(*) AS k, min(-py - ey / 2) AS o FROM nodes WHERE grp = 'static' AND node <= 3 GROUP BY clip),
e AS (SELECT DISTINCT clip, object_id FROM (SELECT DISTINCT clip FROM nodes), (SELECT unnest(['A', 'N', 'R']) AS object_id)), g AS (SELECT e.clip, e.object_id, CASE WHEN n = 1 AND k = 1 THEN py + o - ey / 2 END AS gap FROM e LEFT JOIN b USING (clip, object_id) LEFT JOIN p USING (clip))
SELECT CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < -0.05 THEN 'penetrating' WHEN gap > 0.05 THEN 'separated' ELSE 'compatible' END AS state, count(*) AS n FROM g GROUP BY state""")
def j13_ground_proximity(spark, d):
    n = nodes(spark, d)
    expected = n.select("clip").distinct().withColumn("object_id", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))).withColumn("frame", F.lit(0))
    boxes = n.select("clip", F.col("class").alias("object_id"), F.lit(0).alias("frame"), "py", "ey")
    planes = n.where("grp = 'static' AND node <= 3").select("clip", F.lit(1.0).alias("ny"), F.expr("-py - ey / 2").alias("offset"))
    return M.ground_proximity(expected, boxes, planes).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PREDICTIONS}, t AS (SELECT clip, node, ['static', 'revolute', 'prismatic'][(node % 3 + 1)::INT] AS motion FROM nodes), p AS (SELECT clip, node, CASE WHEN node % 4 = 3 THEN NULL ELSE ['prismatic', 'revolute', 'prismatic'][(node % 3 + 1)::INT] END AS joint FROM predictions), j AS (SELECT motion, joint FROM t LEFT JOIN p USING (clip, node))
SELECT count(*) AS objects, count(joint) AS predicted, count(*) FILTER (WHERE joint = motion) AS "right", count(*) FILTER (WHERE motion <> 'static') AS moving, round(count(*) FILTER (WHERE joint = motion) / greatest(count(joint), 1), 6) AS precision, round(count(*) FILTER (WHERE joint = motion) / greatest(count(*) FILTER (WHERE motion <> 'static'), 1), 6) AS recall FROM j""")
def j14_articulation_outcomes(spark, d):
    pick = lambda *k: F.array(*[F.lit(x) for x in k])[F.expr("cast(node % 3 AS int)")]
    t = nodes(spark, d).select("clip", "node", pick("static", "revolute", "prismatic").alias("motion"))
    p = predictions(spark, d).select("clip", "node", F.when(F.col("node") % 4 != 3, pick("prismatic", "revolute", "prismatic")).alias("joint"))
    out = M.articulation_outcomes(p, t, ["clip", "node"])
    return out.withColumn("precision", r6(F.col("precision"))).withColumn("recall", r6(F.col("recall")))


@query(f"""WITH {NODES}, a AS (SELECT clip, quantile_cont(d, 0.5) AS v FROM (SELECT g.clip, g.node, min(sqrt((g.px - o.px) ** 2 + (g.pz - o.pz) ** 2)) AS d FROM nodes g JOIN nodes o ON g.clip = o.clip AND g.node <> o.node GROUP BY ALL) GROUP BY clip),
b AS (SELECT clip, min(px) AS x0, max(px) AS x1, min(pz) AS z0, max(pz) AS z1 FROM nodes GROUP BY clip), p AS (SELECT clip, i, x0 + (x1 - x0) * (('0x' || substr(md5(clip || '/' || i || '/x'), 1, 8))::BIGINT / 4294967296::DOUBLE) AS x, z0 + (z1 - z0) * (('0x' || substr(md5(clip || '/' || i || '/z'), 1, 8))::BIGINT / 4294967296::DOUBLE) AS z FROM b, (SELECT unnest(range(16)) AS i)),
u AS (SELECT clip, quantile_cont(d, 0.5) AS v FROM (SELECT p.clip, p.i, min(sqrt((p.x - o.px) ** 2 + (p.z - o.pz) ** 2)) AS d FROM p JOIN nodes o ON p.clip = o.clip GROUP BY ALL) GROUP BY clip)
SELECT u.clip, round(u.v, 5) AS uniform_points, round(a.v, 5) AS other_truth FROM u LEFT JOIN a ON u.clip = a.clip""")
def j9_miss_nulls(spark, d):
    out = M.miss_nulls(nodes(spark, d).select("clip", "node", "px", "pz"), "clip", 16)
    return out.select("clip", F.round("uniform_points", 5).alias("uniform_points"), F.round("other_truth", 5).alias("other_truth"))


@query(f"WITH {QUALITY} SELECT clip, count(*) AS objects, round(avg(coverage), 6) AS mean_coverage, round(avg(depth_measured), 6) AS mean_depth_measured, round(avg(span_ratio), 6) AS mean_span_ratio FROM q GROUP BY clip")
def a4_clip_aggregates(spark, d):
    return E.clip_aggregates(_quality(spark, d), "clip", ["coverage", "depth_measured", "span_ratio"])


ARMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH {POOLED}, l AS (SELECT config, 'median_error' AS metric, median_error AS v FROM pooled UNION ALL SELECT config, 'mean_recall', mean_recall FROM pooled)
SELECT metric, {", ".join(f"max(CASE WHEN config = '{a}' THEN v END) AS " + chr(34) + a + chr(34) for a in ARMS)} FROM l GROUP BY metric""")
def a3_arms_side_by_side(spark, d):
    return E.arms_side_by_side(_pooled(spark, d), "config", ARMS, ["median_error", "mean_recall"])

"""The rule-table gate, judged edits and validated repairs on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from sceneloom.operators import edits as X
from sceneloom.operators import quality_rules as Q
from sceneloom.operators.evaluation import identity_entropy
from sceneloom.operators.rules import flatten_json

OBJECT = "clip long, object_id string, " + ", ".join(f"{m} double" for m in [r[2] for r in Q.RULES if r[1] == "object"]) + ", has_hypotheses boolean"
GOOD = {"coverage": 0.9, "bbox_measured": 1.0, "mask_measured": 1.0, "depth_measured": 1.0, "visible_measured": 1.0, "max_gap": 0.0, "span_ratio": 1.0, "attribute_unknown_ratio": 0.0,
        "identity_entropy": 0.1, "motion_support": 0.9, "severe_occlusion": 0.0}


def assess(spark, objects, cameras=None, clips=None, configs=None, structure=()):
    names = [r[2] for r in Q.RULES if r[1] == "object"]
    rows = [(clip, name, *[{**GOOD, **more}[m] for m in names], True) for clip, name, more in objects]
    ids = sorted({r[0] for r in rows} | set(clips or {}) | {s[0] for s in structure})
    cameras = cameras if cameras is not None else {i: (1.0, 1.0) for i in ids}
    said, decided = Q.assess(
        spark.createDataFrame(rows, OBJECT), spark.createDataFrame([(c, *v) for c, v in cameras.items()], "clip long, frame_coverage double, span_ratio double"),
        spark.createDataFrame([(i, (clips or {}).get(i, 1.0)) for i in ids], "clip long, scale_factor double"), Q.thresholds(spark, configs or {"default": Q.DEFAULTS}),
        spark.createDataFrame(list(structure), "clip long, severity string, code string, path string"))
    return [(r.config, r.clip, r.code) for r in said.collect()], {(r.config, r.clip): r.decision for r in decided.collect()}


def test_hypotheses_of_no_confidence_have_no_entropy(spark):
    rows = [(1, "a", 0.0), (2, "a", 0.0), (2, "a", 0.0), (2, "b", 1.0), (2, "b", 1.0), (3, "a", None), (3, "a", 0.0)]
    out = identity_entropy(spark.createDataFrame(rows, "clip long, h string, p double"), ["clip"], "h", "p").orderBy("clip").collect()
    assert [(r.entropy, r.has_unknown) for r in out] == [(None, True), (1.0, True), (None, True)]


def test_every_rule_fires_on_its_side_of_the_bound_only(spark):
    cases, want = [], {}
    for i, (key, scope, metric, side, code) in enumerate(r for r in Q.RULES if r[1] == "object"):
        bound = Q.DEFAULTS[key]
        bad = bound - 0.01 if side == "<" else bound + 0.01
        cases += [(2 * i, "o", {metric: bad}), (2 * i + 1, "o", {metric: float(bound)})]
        want[2 * i] = code
    said, decided = assess(spark, cases)
    assert sorted((c, code) for _, c, code in said) == sorted(want.items())
    assert all(d == ("warn" if c in want else "proceed") for (_, c), d in decided.items())


def test_cameras_unknowns_alignment_and_missing_objects(spark):
    said, decided = assess(spark, [(1, "o", {}), (2, "o", {"motion_support": None}), (3, "o", {"identity_entropy": None}), (4, "o", {})], {1: (0.4, 0.6), 2: (1.0, 1.0), 3: (1.0, 1.0), 4: (1.0, 1.0), 5: (1.0, 1.0)}, {4: 8.5, 5: 8.0})
    assert sorted(said) == [("default", 1, "low_camera_frame_coverage"), ("default", 1, "short_camera_span"), ("default", 2, "motion_support_unknown"), ("default", 3, "identity_ambiguity_unknown"),
                            ("default", 4, "world_alignment_degenerate"), ("default", 5, "no_evidence_objects")]
    assert set(decided.values()) == {"warn"}


def test_a_structural_error_blocks_and_silences_the_rest(spark):
    said, decided = assess(spark, [(1, "o", {"coverage": 0.0}), (2, "o", {}), (3, "o", {})], structure=[(1, "error", "depth_order", "o/1"), (2, "warning", "unknown_depth", "o/2")])
    assert sorted(said) == [("default", 1, "depth_order"), ("default", 2, "unknown_depth")]
    assert {c: d for (_, c), d in decided.items()} == {1: "block", 2: "warn", 3: "proceed"}


def test_configurations_and_thresholds_that_are_missing_or_wrong(spark):
    configs = {"lax": {**Q.DEFAULTS, "min_bbox_coverage": 0.0}, "part": {"min_bbox_coverage": 0.9}, "bad": {**Q.DEFAULTS, "max_track_gap_frames": 1.5, "min_depth_coverage": -0.1, "min_mask_coverage": float("nan")}}
    said, decided = assess(spark, [(1, "o", {"bbox_measured": 0.5, "max_gap": 99.0})], configs=configs)
    assert sorted(said) == [("bad", 1, "low_bbox_coverage"), ("lax", 1, "track_break"), ("part", 1, "low_bbox_coverage")]
    rules, wrong = Q.rule_table(Q.thresholds(spark, configs))
    told = {(r.config, r.key): r.code for r in wrong.collect()}
    assert {k for k, v in told.items() if v == "invalid_quality_threshold"} == {("bad", "max_track_gap_frames"), ("bad", "min_depth_coverage"), ("bad", "min_mask_coverage")}
    assert sum(k[0] == "part" for k in told) == len(Q.DEFAULTS) - 1 and rules.where("config = 'part'").count() == 1


# --- edits


def leaves(spark, documents):
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "key string, d string")
    return flatten_json(spark, rows, "key", "d")


PROGRAM = {"meta": {"units": "m", "on": True}, "objects": [{"id": "a", "pos": [1.0, 2, 3.5]}, {"id": "b/c~", "pos": [0, 0, 0]}]}


def edited(**changes):
    out = json.loads(json.dumps(PROGRAM))
    for path, value in changes.items():
        i, field, *rest = path.split("_")
        if rest:
            out["objects"][int(i[1:])][field][int(rest[0])] = value
        else:
            out["objects"][int(i[1:])][field] = value
    return out


def judge(spark, after, wanted, tolerance=None, before=None, **case):
    before = PROGRAM if before is None else before
    b, a, w = (leaves(spark, {"k": d}) for d in (before, after, wanted))
    digest = X.document_digest(leaves(spark, {"k": PROGRAM})).first().digest
    c = {"status": "applied", "expect_refuse": False, "ops": 1, "note": "", "baseline": digest, **case}
    cases = spark.createDataFrame([("k", c["status"], c["expect_refuse"], c["ops"], c["note"], c["baseline"])], "key string, status string, expect_refuse boolean, ops int, note string, baseline string")
    t = spark.createDataFrame([("k", p, float(v)) for p, v in (tolerance or {}).items()], "key string, pointer string, tolerance double")
    return X.judge_edits(cases, b, a, w, t).first()


@pytest.mark.parametrize(
    "after, wanted, tolerance, reason",
    [
        (edited(o0_pos_0=4.0), edited(o0_pos_0=4.0), None, "as_wanted"), (edited(o0_pos_0=4), edited(o0_pos_0=4.0), None, "as_wanted"), (edited(o0_pos_0=4.1), edited(o0_pos_0=4.0), None, "wrong"),
        (edited(o0_pos_0=4.1), edited(o0_pos_0=4.0), {"/objects/0": 0.2}, "as_wanted"), (edited(o0_pos_0=4.1), edited(o0_pos_0=4.0), {"/objects/0/pos/0": 0.2}, "as_wanted"),
        (edited(o0_pos_0=4.1, o0_pos_1=2.1), edited(o0_pos_0=4.0, o0_pos_1=2.5), {"/objects/0": 0.5, "/objects/0/pos/1": 0.1}, "wrong"),
        (edited(o0_pos_0=4.0, o1_pos_2=1), edited(o0_pos_0=4.0), None, "side_effect"), (edited(o0_id="x"), edited(o0_id="x"), {"/objects/0/id": 1.0}, "invalid_tolerance"),
        (edited(o0_pos_0=4.0), edited(o0_pos_0=4.0), {"/objects/0/pos/0": -1}, "invalid_tolerance"), (edited(o0_pos_0=4.0), edited(o0_pos_0=4.0), {"/objects/1": 1}, "invalid_tolerance"),
        (PROGRAM, PROGRAM, None, "already_satisfied"), (edited(o0_pos_0=True), edited(o0_pos_0=1.5), None, "wrong"), (edited(o0_pos_0="4.0"), edited(o0_pos_0=4.0), None, "wrong"), (edited(o0_pos=[4.0]), edited(o0_pos=[4.0, 2]), None, "side_effect"),
        ({**PROGRAM, "extra": 1}, PROGRAM, None, "side_effect"),
    ],
)
def test_edits_are_compared_whole(spark, after, wanted, tolerance, reason):
    r = judge(spark, after, wanted, tolerance)
    assert (r.reason, r.passed) == (reason, reason in ("as_wanted", "already_satisfied"))


@pytest.mark.parametrize(
    "case, reason",
    [
        ({"baseline": None}, "baseline_missing"), ({"baseline": "0" * 64}, "baseline_mismatch"), ({"expect_refuse": True, "status": "refused", "ops": 0, "note": "no such lamp"}, "refused"),
        ({"expect_refuse": True, "status": "refused", "ops": 0, "note": "  "}, "not_refused"), ({"expect_refuse": True, "status": "applied", "ops": 2}, "invented"), ({"expect_refuse": True, "status": "failed", "ops": 0}, "not_refused"),
        ({"status": "failed"}, "not_applied"), ({"status": None}, "not_applied"), ({"status": "no_change"}, "already_satisfied"),
    ],
)
def test_refusals_and_baselines(spark, case, reason):
    assert judge(spark, PROGRAM, PROGRAM, **case).reason == reason


def test_the_digest_ignores_the_order_of_keys_but_not_of_lists(spark):
    a, b, c = ({"x": 1, "y": [1, 2]}, {"y": [1, 2], "x": 1}, {"x": 1, "y": [2, 1]})
    got = {r.key: r.digest for r in X.document_digest(leaves(spark, {"a": a, "b": b, "c": c})).collect()}
    assert got["a"] == got["b"] != got["c"]


# --- repairs

NODE = "clip long, node long, grp string, px double, py double, pz double, ex double, ey double, ez double, qx double, qy double, qz double, qw double, flat boolean, support long, motion string, interactive boolean"
TABLE = dict(node=1, grp="static", px=0.0, py=0.5, pz=0.0, ex=4.0, ey=1.0, ez=4.0, qx=0.0, qy=0.0, qz=0.0, qw=1.0, flat=True, support=None, motion=None, interactive=False)
CUP = dict(node=2, grp="object", px=0.0, py=1.3, pz=0.0, ex=1.0, ey=0.4, ez=1.0, qx=0.0, qy=0.0, qz=0.0, qw=1.0, flat=None, support=1, motion="static", interactive=False)


def repair(spark, cup=None, table=None, more=(), evidence=None, contact=None, centre=None, clip=None):
    names = [c.split()[0] for c in NODE.split(", ")]
    nodes = [{**TABLE, **(table or {})}, {**CUP, **(cup or {})}, *more]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    e = {"is_dynamic": False, "motion": "static", "geometry_conf": 0.9, **(evidence or {})}
    c = {"with_node": 1, "proximity": False, "conf": 0.9, **(contact or {})}
    m = {"x": 0.0, "y": 1.2, "z": 0.0, "conf": 0.9, **(centre or {})}
    g = {"decision": "proceed", "evidence_clip": 1, "units": "m", "up": "y", "scale": "metric", **(clip or {})}
    work, done, left = X.repair_programs(
        frame([tuple({**n, "clip": 1}[k] for k in names) for n in nodes], NODE), frame([(1, 2, *e.values())], "clip long, node long, is_dynamic boolean, motion string, geometry_conf double"),
        frame([(1, 2, *c.values())], "clip long, node long, with_node long, proximity boolean, conf double"), frame([(1, 2, *m.values())], "clip long, node long, x double, y double, z double, conf double"),
        frame([(1, *g.values())], "clip long, decision string, evidence_clip long, units string, up string, scale string"))
    return {r.node: r for r in work.collect()}, [(r.node, r.code, r["pass"], r.accepted) for r in done.collect()], {(r.node, r.code): r.reason for r in left.collect()}


def test_a_small_gap_is_closed(spark):
    work, done, left = repair(spark)
    assert abs(work[2].py - 1.2) < 1e-12 and done == [(2, "support_gap", 1, True)] and left == {}


def test_orientations_come_first_and_contacts_after(spark):
    work, done, left = repair(spark, {"qw": 1.01})
    assert work[2].qw == 1.0 and abs(work[2].py - 1.2) < 1e-12 and left == {}
    assert done == [(2, "non_unit_quaternion", 1, True), (2, "support_gap", 2, True)]
    work, done, left = repair(spark, {"qw": 1.01}, {"qw": 0.9})
    assert done == [(2, "non_unit_quaternion", 1, True)] and left == {(1, "non_unit_quaternion"): "norm_too_far", (2, "support_gap"): "not_eligible"} and work[2].py == 1.3


def test_a_pass_that_does_not_clear_its_finding_is_taken_back(spark):
    work, done, left = repair(spark, {"py": -0.37}, {"py": -1.0}, centre={"y": -0.3})
    assert done == [(2, "support_penetration", 1, False)] and work[2].py == -0.37
    deep = repair(spark, {"py": -0.23}, {"py": -1.0}, centre={"y": -0.3})
    assert deep[1] == [(2, "support_gap", 1, False)] and deep[0][2].py == -0.23
    assert deep[2] == {(2, "support_gap"): "rolled_back", (2, "ground_penetration"): "not_eligible"}


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"cup": {"support": None}}, None), ({"cup": {"motion": "linear"}}, "moving"), ({"cup": {"interactive": True}}, "moving"), ({"clip": {"units": "cm"}}, "no_metres"), ({"clip": {"scale": "relative"}}, "scale_not_metric"),
        ({"table": {"flat": False}}, "support_not_flat"), ({"table": {"qx": 0.1, "qw": 0.99498744}}, "support_tilted"), ({"cup": {"px": 2.2}}, "little_overlap"), ({"cup": {"py": 1.4}}, "too_far"),
        ({"more": [{**TABLE, "node": 3, "py": 0.52}]}, "several_supports"), ({"evidence": {"is_dynamic": True}}, "evidence_not_static"), ({"evidence": {"motion": "spin"}}, "evidence_not_static"), ({"evidence": {"geometry_conf": 0.7}}, "weak_geometry"),
        ({"contact": {"with_node": 9}}, "contact_ambiguous"), ({"contact": {"proximity": True}}, "proximity_only"), ({"contact": {"conf": 0.7}}, "weak_contact"), ({"centre": {"conf": 0.5}}, "no_centre"), ({"centre": {"y": 1.5}}, "centres_disagree"),
        ({"clip": {"decision": "warn"}}, "evidence_not_proceed"), ({"clip": {"evidence_clip": 2}}, "evidence_clip_mismatch"), ({"more": [{**CUP, "node": 3, "support": None, "ex": 0.0}]}, "unrelated_error"),
    ],
)
def test_what_is_not_certain_is_left_and_named(spark, change, reason):
    work, done, left = repair(spark, **change)
    assert done == [] and work[2].py == change.get("cup", {}).get("py", 1.3)
    assert left.get((2, "support_gap")) == reason


def test_clips_are_transactions_of_their_own(spark):
    n = spark.range(40).selectExpr("id AS clip")
    node = lambda **v: n.select("clip", *[F.lit(v[c.split()[0]]).cast(c.split()[1]).alias(c.split()[0]) for c in NODE.split(", ")[1:]])
    low = F.when(F.col("clip") % 4 == 0, F.col("py") - 2).otherwise(F.col("py"))
    nodes = node(**TABLE).unionByName(node(**CUP)).withColumn("py", low)
    rows = lambda expr: n.selectExpr("clip", "2L AS node", *expr)
    work, done, left = X.repair_programs(
        nodes, rows(["false AS is_dynamic", "'static' AS motion", "0.9D AS geometry_conf"]), rows(["1L AS with_node", "false AS proximity", "0.9D AS conf"]),
        rows(["0D AS x", "CASE WHEN clip % 4 = 0 THEN -0.8D ELSE 1.2D END AS y", "0D AS z", "0.9D AS conf"]), n.selectExpr("clip", "'proceed' AS decision", "clip AS evidence_clip", "'m' AS units", "'y' AS up", "'metric' AS scale"))
    assert {(r.clip % 4 == 0, r.accepted) for r in done.collect()} == {(True, False), (False, True)}
    assert all(abs(r.py - (-0.7 if r.clip % 4 == 0 else 1.2)) < 1e-9 for r in work.where("node = 2").collect()) and work.count() == 80

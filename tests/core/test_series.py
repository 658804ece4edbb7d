"""Time series: edges that the registered queries do not reach."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sceneloom.operators import geometry as G
from sceneloom.operators import grouped, motion_fit, series
from sceneloom.operators.evaluation import paired_tests, perturb, pool_report
from sceneloom.components import connected_components


def test_resampling_never_leaves_the_support(spark):
    track = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 2.0, 4.0, 1.0)], "k int, t double, x double, y double")
    asks = spark.createDataFrame([(1, t) for t in (-0.1, 0.0, 0.5, 2.0, 2.1)] + [(2, 0.0)], "k int, t double")
    got = {(r.k, r.t): r.x for r in series.resample_linear(track, asks, ["k"]).collect()}
    assert got == {(1, -0.1): None, (1, 0.0): 0.0, (1, 0.5): 1.0, (1, 2.0): 4.0, (1, 2.1): None, (2, 0.0): None}


def test_steps_of_eight_degrees_in_all_are_a_hinge_in_any_order(spark):
    steps = [k / 20 for k in (24, 26, 2, 16, 32, 31, 25, 4)]
    orders = [steps[i:] + steps[:i] for i in range(8)]
    assert {list(itertools.accumulate(o))[-1] for o in orders} == {8.0, 7.999999999999999}
    rows = [(i, x, x, 0.0, 1.0, 0.0, 0.0, 1.0) for i, o in enumerate(orders) for x in o] + [(99, 1e30, 8.0, 0.0, 1.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, step_m double, step_deg double, axis_x double, axis_y double, axis_z double, travel_m double, diag double").coalesce(1)
    assert {r.joint for r in G.infer_articulation(df, ["k"]).collect()} == {"hinge"}


def test_groups_become_objects_one_at_a_time(spark):
    class Arrays(list):
        def __getitem__(self, i):
            made.append(i)
            return super().__getitem__(i)

    made = []
    batch = pa.RecordBatch.from_pylist([{"k": k, "rows": [{"x": k}] * 3} for k in (None, 1, 2)])
    spy = type("Batch", (), {"num_rows": 3, "columns": [batch.column("k"), Arrays(batch.column("rows"))]})
    for n, (key, rows) in enumerate(grouped._reader()([spy])):
        assert made == list(range(n + 1)) and (key, rows) == (((None, 1, 2)[n],), [{"x": (None, 1, 2)[n]}] * 3)
    (_, m), (_, late) = grouped._reader(True)([pa.RecordBatch.from_pylist([{"k": 1, "rows": [{"x": 1, "y": 0.5}, {"x": 2, "y": None}]}, {"k": 2, "rows": [{"x": 3, "y": 4.0}]}])])
    assert m.tolist()[0] == [1.0, 0.5] and m[1, 0] == 2.0 and np.isnan(m[1, 1]) and late.tolist() == [[3.0, 4.0]]
    rows = spark.createDataFrame([(k % 40, k // 40, float(-k)) for k in range(4000)], "k long, g long, x double").repartition(7)
    out = grouped.map_groups(rows, ["g", "k"], ["x"], lambda key, group: [(*key, [r["x"] for r in group])] * 30, "a long, b long, xs array<double>").collect()
    assert len(out) == 120_000 and len({(r.g, r.k) for r in out}) == 4000
    assert all((r.g, r.k) == (r.a, r.b) and r.xs == [float(-r.g * 40 - r.k)] for r in out)


def test_a_corrupted_tail_does_not_reach_the_fit(spark):
    rows = [(1, float(t), float(t)) for t in range(11)]
    bad = [(k, t, x * 100 if t > 8 else x) for k, t, x in rows]
    fit = lambda r: sorted((x.t, x.x) for x in series.holdout_cut(spark.createDataFrame(r, "k int, t double, x double"), ["k"]).where("window = 'fit'").collect())
    assert fit(rows) == fit(bad) and len(fit(rows)) == 9


def test_sampling_keeps_the_last_frame_of_a_bucket(spark):
    from pyspark.sql import functions as F

    frames = spark.createDataFrame([(1, i, i / 30) for i in range(90)], "clip int, event_id long, t double")
    got = sorted(r.event_id for r in series.sample_frames(frames, 1.0, F.lit(0.0), 3.0, ["clip"]).collect())
    assert got == [14, 44, 74]


def test_unwrapping_equals_the_sequential_rule(spark):
    rnd = np.random.default_rng(1)
    values = np.cumsum(rnd.normal(0, 30, 60))
    rows = [(1, i, float(v % 90)) for i, v in enumerate(values)]
    got = [r.unwrapped for r in series.unwrap_angle(spark.createDataFrame(rows, "k int, i int, a double"), ["k"], ["i"], "a", 90.0).orderBy("i").collect()]
    assert np.allclose((np.array(got) - np.array([r[2] for r in rows])) % 90 % 90, 0, atol=1e-6) or np.allclose(np.abs(((np.array(got) - np.array([r[2] for r in rows]) + 45) % 90) - 45), 0, atol=1e-6)
    assert np.abs(np.diff(got)).max() <= 45 + 1e-9


def about(axis, degrees):
    half = np.radians(np.asarray(degrees, float)) / 2
    return np.column_stack([np.sin(half)[:, None] * np.asarray(axis, float), np.cos(half)])


def test_motion_types(spark):
    t = np.linspace(0, 6, 61)
    still, up = np.zeros((61, 3)), [0, 1, 0]
    flat = about(up, np.zeros(61))
    move = lambda x: np.stack([x, still[:, 0], still[:, 0]], axis=1)
    kind = lambda *a, **k: motion_fit.classify_motion(*a, **k)
    assert kind(t, still, flat).motion == "static"
    assert kind(t, still).motion == "unknown" and kind(t, still).moves is False  # without orientations a spin is not ruled out
    slide = kind(t, move(0.3 * t), flat)
    assert slide.motion == "prismatic" and np.allclose(slide.best.axis, [1, 0, 0]) and abs(slide.best.rate - 0.3) < 1e-9
    wave = kind(t, move(0.5 * np.sin(2 * np.pi * t / 1.5 + 0.4)), flat)
    assert wave.motion == "periodic_translate" and abs(wave.best.period - 1.5) < 0.05 and abs(wave.best.amp - 0.5) < 0.02
    assert kind(t, move(0.5 * np.sin(2 * np.pi * t / 12)), flat).motion != "periodic_translate"
    spin = kind(t, still, about(up, 70 * t))
    assert spin.motion == "spin" and abs(spin.best.rate - 70) < 1e-6 and np.allclose(spin.best.axis, up)
    signs = np.where(np.arange(61) % 2, -1, 1)[:, None]  # q and -q are one rotation
    assert kind(t, still, signs * about(up, 70 * t)).motion == "spin"
    swing = kind(t, still, about([0, 0, 1], 25 * np.sin(2 * np.pi * t / 2)))
    assert swing.motion == "periodic_rotate" and abs(swing.best.period - 2) < 0.05 and abs(swing.best.amp - 25) < 1.5
    angle = np.linspace(0, 80, 61)
    door = np.stack([2 + np.cos(np.radians(angle)), np.ones(61), 3 - np.sin(np.radians(angle))], axis=1)
    hinge = kind(t, door, about(up, angle))
    assert hinge.motion == "revolute" and np.allclose(hinge.best.pivot, [2, 1, 3], atol=1e-6) and np.allclose(hinge.best.axis, up, atol=1e-6)
    noisy = np.random.default_rng(4).normal(0, 0.004, (61, 3))
    assert kind(t, move(0.3 * t) + noisy, flat).motion == "prismatic" and kind(t, noisy, flat).motion == "static"


def test_motion_gates(spark):
    t = np.linspace(0, 6, 61)
    still, flat = np.zeros((61, 3)), about([0, 1, 0], np.zeros(61))
    why = lambda *a, **k: motion_fit.classify_motion(*a, **k).reason
    assert why(t[:3], still[:3], flat[:3]) == "too_short" and why(t[:5] * 0.1, still[:5], flat[:5]) == "too_short"
    assert why(np.r_[t[:10], t[10:20] + 5], still[:20], flat[:20]) == "gap"
    assert why(t, still, flat, visible=np.full(61, 0.2)) == "occluded"
    assert why(t[:10], still[:10], about([0, 1, 0], 180 * np.arange(10.0))) == "half_turns"
    sparse = np.array([0, 0.1, 0.2, 0.3, 0.65, 1.0, 1.35, 1.7, 2.05, 2.4])
    assert why(sparse, still[:10], flat[:10]) in ("gap", "missing", "fitted")
    assert motion_fit.classify_motion(t, still, flat, visible=np.full(61, 0.2)).motion == "unknown"


def test_motion_of_tracks_with_gaps_in_their_data(spark):
    t = np.linspace(0, 6, 61)
    schema = "k string, t double, x double, y double, z double, qx double, qy double, qz double, qw double, visible double, size double"
    rows = [("slide", float(a), 0.3 * float(a), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.5) for a in t]
    rows += [("twice", float(a), 0.3 * float(a), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.5) for a in t for _ in range(2)]
    rows += [("loose", float(a), 0.3 * float(a), 0.0, 0.0, None, 0.0, 0.0, 1.0, None, None) for a in t]
    rows += [("empty", 1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("zero", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, schema)
    got = {r.k: r for r in motion_fit.estimate_motion(table, ["k"]).collect()}
    assert {k: r.motion for k, r in got.items()} == {"slide": "prismatic", "twice": "prismatic", "loose": "prismatic", "empty": "unknown", "zero": "unknown"}
    assert got["slide"].confidence == got["twice"].confidence and {c.motion for c in got["slide"].candidates} >= {"prismatic"}
    again = {r.k: r for r in motion_fit.estimate_motion(table.orderBy(F.rand(3)).repartition(7), ["k"]).collect()}
    assert again == got
    assert motion_fit.estimate_motion(table.where("false"), ["k"]).count() == 0


def test_shape_kinds(spark):
    rnd = np.random.default_rng(3)
    ball = rnd.normal(size=(400, 3))
    ball /= np.linalg.norm(ball, axis=1, keepdims=True)
    box = rnd.uniform(-1, 1, (600, 3))
    axis = rnd.integers(0, 3, 600)
    box[np.arange(600), axis] = np.sign(box[np.arange(600), axis])
    rows = [("ball", *map(float, p)) for p in ball] + [("box", *map(float, p)) for p in box * [1.0, 0.5, 0.7]]
    got = {r.k: r.kind for r in G.fit_shape_kind(spark.createDataFrame(rows, "k string, x double, y double, z double"), ["k"]).collect()}
    assert got["ball"] == "sphere" and got["box"] == "box"


def test_pooling_counts_objects_not_runs(spark):
    rows = [("c", 0, False)] * 3 + [("c", 1, i < 8) for i in range(10)]
    e = spark.createDataFrame([(c, ok, True, 1.0, 0.0) for c, _, ok in rows], "config string, class_ok boolean, found boolean, distance double, shape_error double")
    runs = spark.createDataFrame([("c", 1.0, 0.5)], "config string, recall double, precision double")
    r = pool_report(e, runs, "config").first()
    assert r.n_objects == 13 and abs(r.class_accuracy - 8 / 13) < 1e-12 and r.std_recall == 0.0


def test_sign_test_and_perturbations(spark):
    r = paired_tests(spark.createDataFrame([(1, 0)] * 9 + [(0, 1)], "a int, b int"), "a", "b").first()
    assert (r.wins, r.losses) == (9, 1) and abs(r.p_value - 22 / 1024) < 1e-9
    n = spark.createDataFrame([(1, 0.0), (2, 1.0)], "node int, px double")
    from pyspark.sql import functions as F

    got = perturb(n, {"shift": {"px": F.col("px") + 1}}, {"drop": F.col("node") == 1}).groupBy("variant").count().collect()
    assert {r.variant: r["count"] for r in got} == {"shift": 2, "drop": 1}


def test_components_match_union_find(spark):
    import random

    rnd = random.Random(6)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {x for a, b in links if a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

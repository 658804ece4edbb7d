"""The scene evaluation on made-up scenes and against a plain version."""

import itertools
import math
import random

import numpy as np
import pytest

from sceneloom.operators import matching
from sceneloom.operators import scene_evaluation as S

STATES = "side string, clip long, kind string, instance string, node string, t double, x double, y double, z double"
NODES = "side string, clip long, node string, class string, motion string, shape string, extent array<double>, asset_ratios array<double>"
CAMERAS = "side string, clip long, t double, x double, y double, z double"


def track(side, name, place, kind="object", clip=1, times=range(11), step=(0.1, 0.0, 0.0)):
    return [(side, clip, kind, name, name, float(t), *(p + s * t for p, s in zip(place, step))) for t in times]


def moved(rows, scale=1.0, yaw=0.0, shift=(0.0, 0.0)):
    """The rows as a prediction in another gauge: turned, scaled and shifted."""
    c, s = math.cos(yaw), math.sin(yaw)
    return [("pred", *r[1:6], scale * (c * r[6] + s * r[8]) + shift[0], scale * r[7], scale * (-s * r[6] + c * r[8]) + shift[1]) for r in rows]


PLACES = {"a": (0.0, 0.5, 0.0), "b": (5.0, 0.5, 1.0), "c": (2.0, 1.0, 7.0), "d": (-4.0, 0.2, 3.0)}
TRUTH = [r for name, place in PLACES.items() for r in track("gt", name, place)]


def run(spark, truth, guess, cameras=(), nodes=None, **params):
    rows = [*truth, *guess]
    nodes = nodes if nodes is not None else [(*k, "thing", "static", "box", [1.0, 2.0, 3.0], None) for k in sorted({(r[0], r[1], r[4]) for r in rows})]
    return S.evaluate_scenes(spark.createDataFrame(rows, STATES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(list(cameras), CAMERAS), S.SceneParams(**params))


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_a_scene_against_itself(spark):
    found = run(spark, TRUTH, moved(TRUTH))
    assert {r.status for r in found.status.collect()} == {"ok"}
    clip = found.clips.first()
    assert (clip.recall, clip.precision, clip.matched, clip.scene_recall, clip.motion_accuracy, clip.shape_error, clip.scale_ratio) == (1, 1, 4, 1, 1, 0, 1)
    for w in found.windows.collect():
        assert w.state == "complete" and w.n == 4 and w.median < 1e-9 and w.max < 1e-9


def test_the_rigid_gauge_is_found(spark):
    clip = lambda rows, n: [(r[0], n, *r[2:]) for r in rows]
    yaws = [0.0, 0.1, math.pi / 2, math.pi + 0.05]
    truth = [r for n in range(4) for r in clip(TRUTH, n)]
    guess = [r for n, yaw in enumerate(yaws) for r in clip(moved(TRUTH, yaw=yaw, shift=(80.0, -30.0)), n)]
    found = run(spark, truth, guess, max_dist=1.0)
    assert [r.matched for r in found.clips.collect()] == [4] * 4 and all(w.max < 1e-6 for w in found.windows.collect())
    assert {r.matched for r in run(spark, truth, guess, gauge="none", max_dist=1.0).clips.collect()} == {0}


def test_a_phantom_does_not_pull_the_gauge(spark):
    guess = moved(TRUTH + track("gt", "ghost", (60.0, 0.5, -40.0)), shift=(3.0, 2.0))
    found = run(spark, TRUTH, guess, max_dist=1.0)
    clip = found.clips.first()
    assert (clip.matched, clip.n_pred, clip.precision) == (4, 5, 0.8) and all(w.max < 1e-6 for w in found.windows.collect())


def camera(side, k=1.0, wide=6.0, times=range(11)):
    return [(side, 1, float(t), k * wide * math.cos(t), k * 1.5, k * wide * math.sin(t)) for t in times]


def test_the_scale_is_the_cameras_whatever_was_detected(spark):
    ghosts = [r for i in range(9) for r in track("gt", f"ghost{i}", (9.0 - 2 * i, 3.0, 11.0 - 3 * i))]
    guess = moved(TRUTH + ghosts, scale=0.25)
    found = run(spark, TRUTH, guess, camera("gt") + camera("pred", 0.25), gauge="similarity", max_dist=0.5)
    gauge = found.gauges.first()
    assert gauge.used == "camera" and math.isclose(gauge.scale, 4.0, rel_tol=1e-9)
    assert found.clips.first().matched == 4 and all(w.max < 1e-6 for w in found.windows.collect())
    assert run(spark, TRUTH, guess, max_dist=0.5).clips.first().matched < 4


def test_a_still_camera_tells_no_scale(spark):
    found = run(spark, TRUTH, moved(TRUTH, scale=0.5), camera("gt", wide=0.01) + camera("pred", 0.5, wide=0.01), gauge="similarity")
    gauge = found.gauges.first()
    assert (gauge.used, gauge.why) == ("none", "still_camera") and math.isclose(gauge.scale, 2.0, rel_tol=1e-6)


@pytest.mark.parametrize(
    "cameras, why",
    [
        ([], "too_few"), (camera("gt"), "too_few"), (camera("gt") + camera("pred") + camera("pred", times=[3]), "repeated_time"),
        (camera("gt", times=range(4)) + camera("pred", times=range(5, 9)), "no_common_span"), (camera("gt") + [("pred", 1, float("nan"), 1.0, 1.0, 1.0)] * 4, "too_few"),
    ],
)
def test_cameras_that_tell_nothing(spark, cameras, why):
    spans = spark.createDataFrame([(1, 0.0, 8.0)], "clip long, begin double, end double")
    spread = spark.createDataFrame([(1, 0.0, 0.0)], "clip long, gt_spread double, pred_spread double")
    r = S.camera_scale(spark.createDataFrame(cameras, CAMERAS), spans, spread).first()
    assert (r.scale, r.used, r.why) == (1.0, "none", why)


def test_cameras_with_other_times_are_compared_at_the_same_ones(spark):
    line = lambda side, k, times: [(side, 1, float(t), k * t, 1.5, 0.0) for t in times]
    spans = spark.createDataFrame([(1, 0.0, 8.0)], "clip long, begin double, end double")
    spread = spark.createDataFrame([(1, 1.0, 1.0)], "clip long, gt_spread double, pred_spread double")
    cameras = line("gt", 1.0, range(9)) + line("pred", 0.2, [1, 2.5, 7, 40])
    r = S.camera_scale(spark.createDataFrame(cameras, CAMERAS), spans, spread).first()
    assert r.used == "camera" and math.isclose(r.scale, 5.0, rel_tol=1e-9)


def test_nothing_after_the_cut_changes_gauge_or_pairs(spark):
    late = lambda rows: [(*r[:6], r[6] + (40 if r[5] > 8 else 0), *r[7:]) for r in rows]
    a, b = run(spark, TRUTH, moved(TRUTH, yaw=0.3)), run(spark, TRUTH, late(moved(TRUTH, yaw=0.3)))
    assert a.gauges.first() == b.gauges.first()
    pairs = lambda f: {(r.gt, r.pred) for r in f.pairs.collect()}
    assert pairs(a) == pairs(b)
    wa, wb = by(a.windows, "window"), by(b.windows, "window")
    assert wa[("fit",)].max == wb[("fit",)].max and wb[("holdout",)].max > 10


def test_structures_are_matched_with_objects_under_the_same_gauge(spark):
    truth = TRUTH + track("gt", "wall", (9.0, 1.0, 9.0), "static", step=(0, 0, 0)) + track("gt", "floor", (9.0, 0.0, -9.0), "static", step=(0, 0, 0))
    guess = moved([r for r in TRUTH if r[3] != "d"] + track("gt", "wall", (9.0, 1.0, 9.0), "object", step=(0, 0, 0)) + track("gt", "d", PLACES["d"], "static"), shift=(1.0, 1.0))
    found = run(spark, truth, guess, max_dist=0.5)
    clip = found.clips.first()
    assert (clip.n_gt, clip.n_pred, clip.matched) == (4, 4, 3) and (clip.scene_gt, clip.scene_pred, clip.scene_matched) == (6, 5, 5)
    kinds = {(r.truth, r.predicted): r.n for r in found.confusions.where("what = 'kind'").collect()}
    assert kinds == {("object", "object"): 3, ("object", "static"): 1, ("static", "object"): 1}
    assert {(r.gt, r.pred) for r in found.scene_pairs.collect()} == {(n, n) for n in "abcd"} | {("wall", "wall")}


def test_agreement_of_matched_nodes(spark):
    nodes = [("gt", 1, n, c, m, s, e, None) for n, c, m, s, e in (("a", "Ball ", "linear", "sphere", [2.0, 2.0, 2.0]), ("b", "door", None, "box", [1.0, 2.0, 4.0]), ("c", "", "static", None, None), ("d", "cat", "revolute", "box", [1.0, 1.0, 1.0]))]
    nodes += [("pred", 1, n, c, m, s, e, a) for n, c, m, s, e, a in (
        ("a", "red ball", "linear", "mesh", [1.0, 1.0, 1.0], [1.0, 0.5, 0.5]), ("b", "gate", "static", "box", [4.0, 2.0, 2.0], None), ("c", "x", "linear", "box", [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]), ("d", "dog", "static", "box", None, [1.0, 1.0, 0.4]))]
    clip = run(spark, TRUTH, moved(TRUTH), nodes=nodes).clips.first()
    assert (clip.class_correct, clip.motion_accuracy, clip.shape_n, clip.geometry_n) == (1, 0.5, 3, 2) and math.isclose(clip.shape_accuracy, 2 / 3)
    assert math.isclose(clip.shape_error, (0 + 0.25 / 3) / 2) and clip.scale_ratio == 0.75 and math.isclose(clip.asset_error, (1 / 3 + 0.2) / 2) and clip.scale_ok == 0.5
    assert (clip.class_accuracy, clip.shape_ok) == (0.25, 1.0)


def test_an_object_whose_motion_was_missed_is_found_by_its_start(spark):
    truth = track("gt", "a", (0.0, 0.5, 0.0), step=(1.0, 0, 0)) + track("gt", "b", (0.0, 0.5, 30.0), step=(0, 0, 0))
    guess = moved(track("gt", "a", (0.0, 0.5, 0.0), step=(0, 0, 0)) + track("gt", "b", (0.0, 0.5, 30.0), step=(0, 0, 0)))
    mean, start = (run(spark, truth, guess, gauge="none", max_dist=1.0, match_on=m).clips.first() for m in ("mean", "start"))
    assert (mean.matched, mean.matched_at_start, mean.only_at_start, start.matched) == (1, 2, 1, 2)


def test_windows_need_support(spark):
    guess = moved(track("gt", "a", PLACES["a"]) + track("gt", "b", PLACES["b"], times=range(9)) + track("gt", "c", PLACES["c"], times=[9, 10]))
    found = run(spark, TRUTH, guess, gauge="none")
    pairs = by(found.pairs, "gt", "window")
    assert pairs[("b", "fit")].coverage == 1 and pairs[("b", "holdout")].reason == "insufficient_time_coverage" and pairs[("b", "full")].coverage == 0.8
    assert {pairs[(n, w)].reason for n in "cd" for w in ("fit", "full", "holdout")} == {"no_prefix_match"}
    windows = {r.window: r.state for r in found.windows.collect()}
    assert windows == {"fit": "partial", "full": "partial", "holdout": "partial"}
    late = run(spark, TRUTH[:-11] + track("gt", "d", PLACES["d"], times=[9, 10]), moved(TRUTH), gauge="none")
    assert by(late.pairs, "gt", "window")[("d", "full")].reason == "not_observed_in_prefix"


def test_clips_that_cannot_be_judged_are_named(spark):
    clip = lambda rows, n: [(r[0], n, *r[2:]) for r in rows]
    rows = [*TRUTH, *moved(TRUTH)]
    broken = clip(rows, 2) + [("gt", 2, "object", "a", "a", 3.0, 0.0, 0.0, 0.0)]
    nan = clip(rows, 3) + [("pred", 3, "object", "n", "n", 3.0, float("nan"), 0.0, 0.0)]
    none = clip(moved(TRUTH), 4) + clip(track("gt", "wall", (0.0, 0.0, 0.0), "static"), 4)
    still = clip([r for r in rows if r[5] == 0], 5)
    strange = clip(rows, 6) + clip(track("pred", "unknown", (0.0, 0.0, 0.0)), 6)
    two = clip(rows, 7) + [("gt", 7, "object", "a", "other", 99.0, 0.0, 0.0, 0.0)]
    every = [*rows, *broken, *nan, *none, *still, *strange, *two]
    nodes = [(*k, "c", "static", "box", None, None) for k in sorted({(r[0], r[1], r[4]) for r in every} - {("pred", 6, "unknown")})]
    found = run(spark, every, [], nodes=nodes)
    assert {r.clip: r.status for r in found.status.collect()} == {
        1: "ok", 2: "invalid_states", 3: "invalid_states", 4: "no_truth", 5: "no_time_span", 6: "state_program_mismatch", 7: "invalid_states"}
    assert [r.clip for r in found.clips.collect()] == [1]


def test_a_clip_without_predictions(spark):
    clip = run(spark, TRUTH, []).clips.first()
    assert (clip.matched, clip.recall, clip.precision, clip.scene_matched, clip.class_accuracy) == (0, 0.0, None, 0, None)


def plain(truth, guess, limit, n, cover):
    """Pairs and window errors of one clip without a gauge, all assignments tried."""
    def tracks(rows):
        out = {}
        for r in sorted(rows, key=lambda r: r[5]):
            out.setdefault(r[3], []).append(r[5:])
        return {k: np.array(v) for k, v in out.items()}

    def at(track, times):
        return np.stack([np.interp(times, track[:, 0], track[:, i]) for i in (1, 2, 3)], axis=1)

    g, p = tracks(truth), tracks(guess)
    t0, t1 = min(v[0, 0] for v in g.values()), max(v[-1, 0] for v in g.values())
    cut = t0 + (t1 - t0) * 0.8
    early = lambda d: {k: v[v[:, 0] <= cut] for k, v in d.items() if (v[:, 0] <= cut).any()}
    eg, ep = early(g), early(p)
    cost = {}
    for a, b in itertools.product(eg, ep):
        times = np.linspace(t0, cut, n)
        times = times[(times >= max(eg[a][0, 0], ep[b][0, 0])) & (times <= min(eg[a][-1, 0], ep[b][-1, 0]))]
        if len(times):
            d = np.linalg.norm(at(eg[a], times) - at(ep[b], times), axis=1).mean()
            if d <= limit:
                cost[a, b] = d
    best = (0, 0.0, {})
    names = sorted(eg)
    for choice in itertools.product(*[[None, *sorted(ep)] for _ in names]):
        pairs = {a: b for a, b in zip(names, choice) if b is not None}
        if len(set(pairs.values())) == len(pairs) and all(x in cost for x in pairs.items()):
            score = (len(pairs), -sum(cost[x] for x in pairs.items()), pairs)
            if score[:2] > best[:2]:
                best = score
    out = {}
    for a, b in best[2].items():
        for name, w0, w1 in (("fit", t0, cut), ("full", t0, t1), ("holdout", cut, t1)):
            lo, hi = max(w0, g[a][0, 0], p[b][0, 0]), min(w1, g[a][-1, 0], p[b][-1, 0])
            if hi > lo and (hi - lo) / (w1 - w0) >= cover:
                times = np.linspace(lo, hi, n)
                out[a, b, name] = np.linalg.norm(at(g[a], times) - at(p[b], times), axis=1).mean()
    return best[2], out


def test_pairs_and_errors_match_a_plain_version(spark):
    rnd = random.Random(21)
    truth, guess = [], []
    for clip in range(12):
        for side, into, n in (("gt", truth, 4), ("pred", guess, 4)):
            for i in range(n):
                times = sorted(rnd.sample(range(12), rnd.randrange(2, 12)))
                into += track(side, f"{side}{i}", [rnd.uniform(0, 3) for _ in range(3)], clip=clip, times=times, step=[rnd.uniform(-0.2, 0.2) for _ in range(3)])
    found = run(spark, truth, guess, gauge="none", max_dist=2.0, samples=30, coverage=0.6)
    got = found.pairs.collect()
    for clip in range(12):
        mine = lambda rows: [r for r in rows if r[1] == clip]  # noqa: B023, E731
        pairs, errors = plain(mine(truth), mine(guess), 2.0, 30, 0.6)
        assert {r.gt: r.pred for r in got if r.clip == clip and r.pred and r.window == "fit"} == pairs
        measured = {(r.gt, r.pred, r.window): r.distance for r in got if r.clip == clip and r.distance is not None}
        assert measured.keys() == errors.keys() and all(math.isclose(measured[k], errors[k], abs_tol=1e-9) for k in errors)


@pytest.mark.parametrize("seed", range(6))
def test_both_ways_to_find_a_shift_agree_with_trying_all(seed, monkeypatch):
    rnd = np.random.default_rng(seed)
    g = rnd.uniform(0, 6, (rnd.integers(1, 14), 3))
    p = np.concatenate([g[: len(g) // 2] + [3.0, 0.0, -2.0] + rnd.normal(0, 0.05, (len(g) // 2, 3)), rnd.uniform(0, 6, (rnd.integers(1, 9), 3))])
    best = (0, 0.0)
    for a, b in itertools.product(g, p):
        shift = (a - b) * [1, 0, 1]
        near = np.linalg.norm(g[:, None] - (p + shift)[None], axis=2).min(axis=1)
        best = max(best, (int((near <= 0.4).sum()), -float(near[near <= 0.4].sum())))
    few = matching.best_shift(g, p, 0.4)
    monkeypatch.setattr(matching, "ALL_AT_ONCE", 0)
    many = matching.best_shift(g, p, 0.4)
    for n, cost, dx, dz in (few, many):
        assert n == best[0] and math.isclose(cost, -best[1], abs_tol=1e-9)
        near = np.linalg.norm(g[:, None] - (p + [dx, 0, dz])[None], axis=2).min(axis=1)
        assert int((near <= 0.4 + 1e-12).sum()) == n

"""Association, assignment, suppression and alignment on fixtures and against brute force."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sceneloom.operators import evaluation, rules, scene
from sceneloom.operators import matching as M

DET = "clip string, frame int, detection_id long, label string, score double, x1 double, y1 double, x2 double, y2 double, position array<double>, appearance array<double>"


def detections(spark, rows):
    return spark.createDataFrame([("c", f, i, label, 0.9, x, y, x + 10.0, y + 10.0, None, look) for f, i, label, x, y, look in rows], DET)


def tracks(spark, rows, **config):
    got = M.associate(detections(spark, rows), config=M.AssociationConfig(**config)).collect()
    return {r.detection_id: r for r in got}


def test_a_late_object_starts_its_own_track(spark):
    rows = [(f, f, "crate", 100.0 + f, 100.0, None) for f in range(3)] + [(2, 9, "ball", 400.0, 300.0, None)]
    got = tracks(spark, rows)
    assert {got[i].track_id for i in range(3)} == {"crate_1"} and got[9].track_id == "ball_1"


def test_gap_limit_decides_over_an_occlusion(spark):
    rows = [(0, 0, "crate", 5.0, 5.0, None), (3, 1, "crate", 5.0, 5.0, None)]
    assert len({r.track_id for r in tracks(spark, rows, max_frame_gap=3).values()}) == 1
    assert sorted(r.track_id for r in tracks(spark, rows, max_frame_gap=2).values()) == ["crate_1", "crate_2"]


def test_crossing_boxes_keep_their_identity_by_appearance(spark):
    a, b = [1.0, 0.0], [-1.0, 0.0]
    rows = [(0, 0, "crate", 0.0, 0.0, a), (0, 1, "crate", 12.0, 0.0, b), (1, 2, "crate", 6.0, 0.0, b), (1, 3, "crate", 6.5, 0.0, a)]
    got = tracks(spark, rows)
    assert got[3].track_id == got[0].track_id and got[2].track_id == got[1].track_id


def test_an_ambiguous_detection_starts_a_track_with_hypotheses(spark):
    rows = [(0, 0, "crate", 0.0, 0.0, None), (0, 1, "crate", 2.0, 0.0, None), (1, 2, "crate", 1.0, 0.0, None)]
    got = tracks(spark, rows)
    assert len({r.track_id for r in got.values()}) == 3 and got[2].code == "ambiguous_split"
    assert {x.track for x in got[2].identity} == {got[0].track_id, got[1].track_id}
    assert abs(sum(x.confidence for x in got[2].identity) - 1) < 1e-5


def test_input_order_does_not_matter(spark):
    rnd = random.Random(3)
    rows = [(f, 10 * f + k, rnd.choice(["crate", "red crate"]), 30.0 * k + rnd.random() * 4, 5.0, None) for f in range(0, 90, 3) for k in range(4)]
    want = sorted((r.detection_id, r.track_id) for r in tracks(spark, rows).values())
    for _ in range(2):
        rnd.shuffle(rows)
        assert sorted((r.detection_id, r.track_id) for r in tracks(spark, rows).values()) == want


def test_cutting_at_silences_gives_the_same_tracks(spark):
    rows = [(f, f * 10 + k, "crate", 40.0 * k, 0.0, None) for f in (0, 1, 2, 60, 61, 200) for k in range(2)]
    got = tracks(spark, rows)
    book, want = M.TrackBook(M.AssociationConfig()), {}
    for f in (0, 1, 2, 60, 61, 200):
        frame = [{"id": i, "detection_id": i, "frame": f, "label": label, "x1": x, "y1": y, "x2": x + 10, "y2": y + 10} for g, i, label, x, y, _ in rows if g == f]
        want |= {ident: name for ident, name, *_ in book.frame(f, frame)}
    assert {i: r.track_id for i, r in got.items()} == want


def plain_assignment(cost, limit):
    n, m = cost.shape
    best = (0, 0.0)
    for k in range(min(n, m), 0, -1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                values = [cost[r, c] for r, c in zip(rows, cols)]
                if max(values) <= limit and (best[0] < k or sum(values) < best[1]):
                    best = (k, sum(values))
        if best[0]:
            return best
    return best


def test_assignment_takes_the_most_pairs_then_the_least_distance(spark):
    rnd = np.random.default_rng(4)
    rows, want = [], {}
    for scene_no in range(25):
        n, m = rnd.integers(1, 5, 2)
        cost = rnd.random((n, m)) * 2
        want[scene_no] = plain_assignment(cost, 1.0)
        rows += [(scene_no, int(i), int(j), float(cost[i, j])) for i in range(n) for j in range(m)]
    table = spark.createDataFrame(rows, "clip int, gt long, pred long, cost double")
    got = {r.clip: (r.n, r.s) for r in M.match_costs(table, ["clip"], 1.0).groupBy("clip").agg(F.count("*").alias("n"), F.sum("cost").alias("s")).collect()}
    for k, (n, s) in want.items():
        assert got.get(k, (0, 0.0))[0] == n and math.isclose(got.get(k, (0, 0.0))[1], s, abs_tol=1e-9)


def test_greedy_pairs_by_rising_distance(spark):
    table = spark.createDataFrame([(1, 1, 1, 0.2), (1, 1, 2, 0.1), (1, 2, 2, 0.15), (1, 2, 1, 0.9)], "clip int, gt long, pred long, cost double")
    assert sorted((r.gt, r.pred) for r in M.match_costs(table, ["clip"], 0.5, greedy=True).collect()) == [(1, 2)]
    assert sorted((r.gt, r.pred) for r in M.match_costs(table, ["clip"], 0.5).collect()) == [(1, 1), (2, 2)]


def test_gauges_recover_a_known_turn_and_shift(spark):
    rnd = np.random.default_rng(6)
    g = rnd.random((6, 3)) * 4
    yaw = math.radians(90)
    p = np.stack([math.cos(yaw) * g[:, 0] - math.sin(yaw) * g[:, 2] + 2, g[:, 1], math.sin(yaw) * g[:, 0] + math.cos(yaw) * g[:, 2] - 1], axis=1)
    rows = [("c", "gt", i, *map(float, x)) for i, x in enumerate(g)] + [("c", "pred", i, *map(float, x)) for i, x in enumerate(p)]
    r = M.coarse_gauge(spark.createDataFrame(rows, "clip string, side string, id int, x double, y double, z double"), ["clip"], 0.1).first()
    assert r.inliers == 6 and r.yaw_deg == 90.0 and r.cost < 1e-6
    pairs = spark.createDataFrame([("c", float(a[0]), float(a[2]), float(b[0]), float(b[2])) for a, b in zip(g, p)], "clip string, gx double, gz double, px double, pz double")
    f = M.fine_gauge(pairs, ["clip"]).first()
    assert math.isclose(f.yaw_deg, 90, abs_tol=1e-6) and math.isclose(f.tx, r.tx, abs_tol=1e-6) and math.isclose(f.tz, r.tz, abs_tol=1e-6)


def test_suppression_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [("c", f, 100 * f + i, rnd.choice("ab"), rnd.choice([0.3, 0.5, 0.9]), x := rnd.random() * 40, y := rnd.random() * 40, x + 20 + rnd.random() * 9, y + 20) for f in range(5) for i in range(12)]
    got = {r.detection_id for r in M.nms(spark.createDataFrame(rows, "clip string, frame int, detection_id long, label string, score double, x1 double, y1 double, x2 double, y2 double"), ["clip", "frame"], 10_000.0, 0.4).collect()}
    want = set()
    for f in range(5):
        kept = []
        for r in sorted((r for r in rows if r[1] == f), key=lambda r: (-r[4], r[3], r[5:9])):
            if all(M._iou(r[5:9], k) <= 0.4 for k in kept):
                kept.append(r[5:9])
                want.add(r[2])
    assert got == want


def test_duplicates_keep_the_better_supported(spark):
    schema = "clip long, node long, class string, px double, py double, pz double, ex double, ey double, ez double, frames long, confidence double"
    rows = [(1, 1, "Crate", 0.0, 0.0, 0.0, 0.3, 0.3, 0.3, 3, 0.9), (1, 2, "crate", 0.05, 0.0, 0.0, 0.3, 0.3, 0.3, 30, 0.1), (1, 3, "cup", 0.05, 0.0, 0.0, 0.3, 0.3, 0.3, 1, 0.1), (1, 4, "crate", 0.6, 0.0, 0.0, 0.3, 0.3, 0.3, 1, 0.1)]
    got = {r.node: r.kept_as for r in scene.merge_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}


def test_chains_and_voxels(spark):
    schema = "clip long, node long, px double, py double, pz double, ex double, ey double, ez double"
    row = [(1, i, 0.5 * i, 0.0, 0.0, 0.3, 0.1, 0.1) for i in range(5)] + [(1, 10, 90.0, 0.0, 0.0, 0.3, 0.1, 0.1), (2, 1, 0.0, 0.0, 0.0, 0.3, 0.3, 0.3), (2, 2, 0.1, 0.1, 0.1, 0.3, 0.3, 0.3)]
    got = scene.fragment_chains(spark.createDataFrame(row, schema)).collect()
    assert [(r.clip, r.members) for r in got] == [(1, 5)]
    pts = [(1, i * 0.4, 0.0, 0.0) for i in range(50)] + [(1, 100 + i * 0.4, 0.0, 0.0) for i in range(30)] + [(1, 500.0, 0.0, 0.0)]
    clusters = scene.voxel_clusters(spark.createDataFrame(pts, "clip long, x double, y double, z double"), ["clip"], 0.5).collect()
    assert sorted(r.points for r in clusters) == [30, 50]


def test_chains_and_voxels_are_joined_where_they_are(spark, monkeypatch):
    """Small clips and points of one cube of cells need no links between tasks."""
    def never(*_):
        raise AssertionError("links were made")

    monkeypatch.setattr(scene, "connected_components", never)
    row = [(c, i, 0.5 * i, 0.0, 0.0, 0.3, 0.1, 0.1) for c in range(3) for i in range(5)]
    got = scene.fragment_chains(spark.createDataFrame(row, "clip long, node long, px double, py double, pz double, ex double, ey double, ez double")).collect()
    assert sorted((r.clip, r.component, r.members) for r in got) == [(c, 0, 5) for c in range(3)]
    pts = spark.createDataFrame([(c, i * 0.4, 0.0, 0.0) for c in range(3) for i in range(30)], "clip long, x double, y double, z double")
    assert sorted((r.clip, r.points) for r in scene.voxel_clusters(pts, ["clip"], 0.5).collect()) == [(c, 30) for c in range(3)]


def test_chains_in_pieces_and_voxels_in_cubes(spark):
    rnd = random.Random(4)
    rows = [(c, i, *(rnd.uniform(0, s) for s in (14, 3, 3)), *(rnd.uniform(0.1, 0.9) for _ in range(3))) for c in ("a", "b", None) for i in range(40)]
    nodes = spark.createDataFrame(rows, "clip string, node long, px double, py double, pz double, ex double, ey double, ez double")
    whole, cut = ({(r.clip, r.component, r.members, round(r.bx, 9), round(r.by, 9), round(r.bz, 9)) for r in scene.fragment_chains(nodes, 1.0, 1.0, small).collect()} for small in (64, 7))
    assert whole == cut and len({r[0] for r in whole}) == 3

    pts = [(c, *(rnd.randint(-9, 9) * 1.0 for _ in range(3))) for c in (1, 2) for _ in range(400)] + [(None, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 1.0), (1, None, 0.0, 0.0), (1, None, 0.0, 1.0)]
    cells = {p for p in pts if None not in p}
    want = [(1, 1)] * 2 + [(None, 1)] * 2
    while cells:
        todo, group = [cells.pop()], set()
        while todo:
            group.add(p := todo.pop())
            near = {q for q in cells if p[0] == q[0] and max(abs(a - b) for a, b in zip(p[1:], q[1:])) <= 1}
            cells -= near
            todo += near
        want.append((p[0], sum(q in group for q in pts)))
    df = spark.createDataFrame(pts, "clip long, x double, y double, z double")
    for width in (2, 5, 32):
        got = scene.voxel_clusters(df, ["clip"], 1.0, 1, width).collect()
        assert sorted(((r.clip, r.points) for r in got), key=str) == sorted(want, key=str) and len({r.component for r in got}) == len(got)


def test_chains_of_any_clip_and_node_names(spark):
    """Clips are strings, nodes beyond a million; one huge node far away pairs with nobody, and clips do not meet."""
    schema = "clip string, node long, px double, py double, pz double, ex double, ey double, ez double"
    rows = [("a", 1_000_001 + i, 0.5 * i, 0.0, 0.0, 0.3, 0.1, 0.1) for i in range(4)] + [("b", 1, 0.0, 0.0, 0.0, 0.3, 0.1, 0.1), ("b", 2, 491.0, 0.0, 0.0, 0.3, 0.1, 0.1)]
    rows += [("c", 1, 1e6, 0.0, 0.0, 5_000.0, 1.0, 1.0), ("c", 2, 0.0, 0.0, 0.0, 0.3, 0.1, 0.1), (None, 1, 0.0, 0.0, 0.0, 0.3, 0.1, 0.1), (None, 2, 0.4, 0.0, 0.0, 0.3, 0.1, 0.1)]
    got = scene.fragment_chains(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.clip, r.component, r.members) for r in got), key=str) == sorted([("a", 1_000_001, 4), (None, 1, 2)], key=str)


def test_near_pairs_match_all_pairs(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), i, *(rnd.uniform(0, 30) for _ in range(3)), 10 ** rnd.uniform(-2, 1.3)) for i in range(160)]
    table = spark.createDataFrame(rows, "clip string, id long, px double, py double, pz double, diag double")
    got = {tuple(sorted((r.a, r.b))) for r in scene._near_pairs(table, 1.5).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:5], b[2:5]) <= 1.5 * (a[5] + b[5]) / 2}
    assert got == want and len(want) > 100


def plain_gauge(g, p, limit):
    """The best of all shifts of pairs, by looking at every one."""
    best = (0, 0.0)
    for gi in g:
        for pj in p:
            shift = gi - pj
            shift[1] = 0.0
            far = np.sqrt(((g[:, None] - p[None] - shift) ** 2).sum(2)).min(1)
            inside = far[far <= limit]
            best = max(best, (len(inside), -float(inside.sum())))
    return best[0], -best[1]


def test_best_shift_matches_all_shifts():
    rnd = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 5), (8, 8), (12, 5)]:
        for _ in range(12):
            g, p = rnd.random((n, 3)) * [6, 1, 6], rnd.random((m, 3)) * [6, 1, 6]
            count, cost, dx, dz = M.best_shift(g, p, 0.7)
            want = plain_gauge(g, p, 0.7)
            assert count == want[0] and math.isclose(cost, want[1], abs_tol=1e-9)
            far = np.sqrt(((g[:, None] - p[None] - [dx, 0, dz]) ** 2).sum(2)).min(1)
            assert (far <= 0.7).sum() == count


def test_three_hundred_objects_are_aligned_in_little_memory():
    import tracemalloc

    rnd = np.random.default_rng(5)
    g = rnd.random((300, 3)) * [80, 2, 80]
    p = g[rnd.permutation(300)] + [3.0, 0.0, -2.0]
    tracemalloc.start()
    count, cost, dx, dz = M.best_shift(g, p, 0.2)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert count == 300 and math.isclose(dx, -3, abs_tol=1e-9) and math.isclose(dz, 2, abs_tol=1e-9)


def test_assignment_by_parts_is_the_assignment_of_all(spark):
    rnd = random.Random(4)
    rows = [(1, g, p, round(rnd.random(), 3)) for g in range(12) for p in range(12) if rnd.random() < 0.15]
    parts = M.feasible_parts([{"gt": g, "pred": p, "cost": c} for _, g, p, c in rows])
    assert len(parts) > 1 and sum(map(len, parts)) == len(rows)
    got = M.match_costs(spark.createDataFrame(rows, "k int, gt long, pred long, cost double"), ["k"], 1.0).collect()
    cost = np.full((12, 12), np.inf)
    for _, g, p, c in rows:
        cost[g, p] = c
    whole = M.assignment(cost, 1.0)
    assert len(got) == len(whole) and math.isclose(sum(r.cost for r in got), sum(cost[i, j] for i, j in whole))


def test_long_chains_of_support_are_no_cycles(spark):
    chain = [("a", i, i + 1) for i in range(6_000)]
    many = [("b", i, j) for i in range(9) for j in range(i + 1, 10)]  # several references a node, no cycle
    ring = [("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 7, 1), ("c", 8, 9), ("c", None, 1), ("c", 4, None)]
    got = rules.support_cycles(spark.createDataFrame(chain + many + ring, "clip string, node_id long, target long")).collect()
    assert sorted((r.clip, r.path) for r in got) == [("c", "1"), ("c", "2"), ("c", "3"), ("c", "7")]


def test_sign_test_is_exact_and_quick():
    for n in range(1, 60):
        for k in range(n + 1):
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
            assert math.isclose(evaluation.sign_test(k, n - k), want, rel_tol=1e-9)
    assert evaluation.sign_test(0, 0) == 1.0
    n = 10**9
    normal = math.erfc((n / 2 - (n / 2 - 30_000)) / math.sqrt(n / 4) / math.sqrt(2))
    assert math.isclose(evaluation.sign_test(n // 2 - 30_000, n // 2 + 30_000), normal, rel_tol=1e-3)


def test_turned_boxes_touch_what_they_reach(spark):
    q = lambda deg: (math.sin(math.radians(deg) / 2), 0.0, 0.0, math.cos(math.radians(deg) / 2))
    schema = "clip string, node long, node_id string, grp string, class string, px double, py double, pz double, ex double, ey double, ez double, qx double, qy double, qz double, qw double, support string"
    rows = [("a", 0, "g", "static", "floor", 0.0, -0.5, 0.0, 50.0, 1.0, 50.0, *q(0), None), ("a", 1, "h", "static", "ground", 0.0, -0.6, 0.0, 50.0, 1.0, 50.0, *q(0), None),
            ("a", 2, "upright", "object", "plank", 0.0, 1.0, 0.0, 0.2, 2.0, 0.2, *q(0), "g"), ("a", 3, "lying", "object", "plank", 0.0, 0.1, 0.0, 0.2, 2.0, 0.2, *q(90), "g"),
            ("a", 4, "sunk", "object", "plank", 0.0, 0.1, 0.0, 0.2, 2.0, 0.2, *q(0), "g"), ("a", 5, "away", "object", "plank", 90.0, 0.1, 0.0, 0.2, 0.2, 0.2, *q(0), "g"),
            ("a", 6, "high", "object", "plank", 0.0, 3.0, 0.0, 0.2, 0.2, 0.2, *q(0), "g"), ("a", 7, "odd", "object", "plank", 0.0, 3.0, 0.0, 0.2, 0.2, 0.2, 0.0, 0.0, 0.0, 1.1, None),
            ("a", 8, "none", "object", "plank", 0.0, 3.0, 0.0, 0.2, 0.2, 0.2, 0.0, 0.0, 0.0, 0.0, None), ("a", 9, "nan", "object", "plank", 0.0, float("nan"), 0.0, 0.2, 0.2, 0.2, 0.0, 0.0, float("inf"), 1.0, None)]
    got = rules.geometry_findings(spark.createDataFrame(rows, schema), ("floor", "ground")).collect()
    assert sorted((r.path, r.code) for r in got) == sorted([("sunk", "ground_penetration"), ("sunk", "support_penetration"), ("away", "support_no_overlap"), ("high", "support_gap"),
                                                          ("odd", "non_unit_quaternion"), ("none", "zero_quaternion"), ("nan", "non_finite_transform"), ("nan", "non_finite_quaternion")])

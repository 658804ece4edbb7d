"""Cameras, likeness, first boxes, arms of naming and the dataset sink against plain versions."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sceneloom.operators import cameras, generation, likeness, retrieval, rules
from sceneloom.sources import datasets, scenes

FRAME = "clip string, t double, x double, y double, z double, lx double, ly double, lz double"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def paths(out):
    views = {}
    for r in sorted(out.collect(), key=lambda r: (r.clip, r.view, r.t)):
        views.setdefault((r.clip, r.view), []).append(r)
    return views


@pytest.fixture(scope="module")
def scene(spark):
    clips = table(spark, [("a", 8.0, 60.0), ("b", 4.0, None), ("none", 2.0, 40.0), ("one", 2.0, 90.0)], "clip string, duration double, fov_deg double")
    frames = table(spark, [("a", 0.0, 10.0, 5.0, 0.0, 0.0, 0.0, 0.0), ("a", 8.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("none", 0.0, 4.0, -3.0, 2.0, None, None, None)], FRAME)
    spots = [("a", k, float(k), 0.5, -float(k), 0.4 + k) for k in range(5)] + [("b", 0, 1.0, 2.0, 3.0, 0.01), ("b", 1, 4.0, 2.0, 3.0, 1.0), ("one", 7, 1.0, 0.0, 1.0, 0.5)]
    return clips, frames, table(spark, spots, "clip string, node long, x double, y double, z double, size double")


def test_orbit_comes_closer_and_turns(scene):
    views = paths(cameras.camera_paths(*scene, "near_orbit", 3, 17))
    assert set(views) == {(c, v) for c in ("a", "none") for v in range(3)}
    full = math.dist((10, 5, 0), (0, 0, 0))
    for v in range(3):
        first, still = views["a", v]
        assert math.isclose(math.dist((first.x, first.y, first.z), (0, 0, 0)), 0.35 * full)
        assert math.isclose(math.atan2(first.z, first.x) % (2 * math.pi), 2 * math.pi * v / 3, abs_tol=1e-9)
        assert (still.x, still.y, still.z) == (1, 1, 1) and first.name == f"a_v{v}"
        assert views["none", v][0].y == cameras.LOWEST and views["none", v][0].lx == 0


def test_walk_passes_every_object_once_and_looks_ahead(scene):
    out = cameras.camera_paths(*scene, "walkthrough", 4, 17, cameras.Path(count=5))
    views = paths(out)
    seen = set()
    for v in range(4):
        walk = views["a", v]  # five key frames for five way-points: each key frame is a way-point
        looks = [(r.lx, r.lz) for r in walk]
        near = [min(range(5), key=lambda k, r=r: abs(math.hypot(r.x - k, r.z + k) - 0.8)) for r in walk]
        assert [r.t for r in walk] == [0.0, 2.0, 4.0, 6.0, 8.0] and {r.y for r in walk} == {0.9}
        assert sorted(near) == list(range(5)) and len(set(looks)) == 4 and looks[-1] == looks[-2]
        assert [(float(k), -float(k)) for k in near[1:]] == looks[:-1]
        seen.add(tuple(near))
        assert [(r.x, r.y, r.z) for r in views["none", v]] == [(4.0, -3.0, 2.0)]
        one = views["one", v]
        assert all((r.lx, r.lz) == (1.0, 1.0) for r in one) and math.isclose(math.dist((one[0].x, one[0].z), (one[-1].x, one[-1].z)), 1.6)
    assert len(seen) > 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, cameras.camera_paths(*[t.repartition(3) for t in scene], "walkthrough", 4, 17, cameras.Path(count=5)).collect()))


def test_arc_keeps_the_object_at_its_size(scene):
    views = paths(cameras.camera_paths(*scene, "object_centric", 7, 3))
    for v in range(7):
        arc = views["a", v]
        k = v % 5
        d = max(0.35, (0.4 + k) / (2 * math.tan(math.radians(30)) * 0.3))
        angles = np.unwrap([math.atan2(r.z + k, r.x - k) for r in arc])
        assert all(math.isclose(math.hypot(r.x - k, r.z + k), d) and (r.lx, r.lz) == (k, -k) for r in arc) and len(arc) == 9
        assert 0.5 * math.pi <= abs(angles[-1] - angles[0]) <= 1.1 * math.pi + 1e-9 and 0.25 * d <= arc[0].y - 0.5 <= 0.75 * d
        assert math.isclose(math.hypot(views["b", 0][0].x - 1, views["b", 0][0].z - 3), 0.35)
        assert views["none", v][0].x == views["none", 0][0].x  # no object: the orbit, not turned
    with pytest.raises(ValueError):
        cameras.camera_paths(*scene, "drone", 1, 3)


@pytest.mark.parametrize("block", [3, 1000])
def test_cross_median_is_that_of_all_pairs(spark, block):
    rnd = np.random.default_rng(5)
    a = {c: rnd.normal(size=(n, 4)).round(1) for c, n in (("x", 17), ("y", 10), ("only", 3))}
    b = {c: rnd.normal(size=(n, 4)).round(1) for c, n in (("x", 9), ("y", 7))}
    a["same"], b["same"] = np.ones((6, 4)), np.ones((5, 4))
    a["zero"], b["zero"] = np.zeros((1, 4)), np.ones((2, 4))
    rows = lambda d: [(c, i, [float(x) for x in v]) for c, m in d.items() for i, v in enumerate(m)] + [("x", 99, None), (None, 1, [1.0] * 4)]
    schema = "clip string, place long, vec array<double>"
    got = {r.clip: r for r in likeness.cross_median(table(spark, rows(a), schema), table(spark, rows(b), schema), block).collect()}
    assert set(got) == set(b)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for c in b:
        cosines = (unit(a[c]) @ unit(b[c]).T).ravel()
        assert got[c].pairs == len(cosines) and math.isclose(got[c].median, np.median(cosines), abs_tol=1e-12)
    assert likeness.cross_median(table(spark, [], schema), table(spark, rows(b), schema), block).count() == 0


def test_cross_median_over_tiles_and_strips(spark):
    rnd = np.random.default_rng(6)
    a, b = rnd.normal(size=(61, 5)), rnd.normal(size=(47, 5))
    t = lambda m: table(spark, [(1, i, [float(x) for x in v]) for i, v in enumerate(m)], "clip long, place long, vec array<double>")
    (r,) = likeness.cross_median(t(a), t(b), 3, tile=8).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert r.pairs == 61 * 47 and math.isclose(r.median, np.median(unit(a) @ unit(b).T), abs_tol=1e-12)


def test_a_task_of_likeness_holds_one_tile():
    def batches():
        for clip in range(50):
            rows = [{"clip": clip, "a_tile": 0, "b_tile": 0, "side": k, "vec": [1.0, 0.0]} for k in (0, 0, 1)]
            yield pa.RecordBatch.from_pylist(rows)
            seen.append(clip)

    seen = []
    for k, (head, a, b) in enumerate(likeness._tiles(batches())):
        assert head["clip"] == k and a.shape == (2, 2) and b.shape == (1, 2) and len(seen) <= k + 1
    assert k == 49


def test_likeness_lies_between_its_yardsticks(spark):
    e = lambda *v: [float(x) for x in v]
    frames = table(spark, [("a", 0, e(1, 0), e(1, 1)), ("a", 1, e(1, 0.1), None), ("n", 0, e(1, 0), None)], "clip string, place long, vec array<double>, render array<double>")
    other = table(spark, [("a", 0, e(0, 1))], "clip string, place long, vec array<double>")
    (r,) = likeness.likeness_report(frames, other, None).collect()
    own, floor = 1 / math.hypot(1, 0.1), (0 + 0.1 / math.hypot(1, 0.1)) / 2
    assert r.n == 1 and r.normalised_against == "unrelated_video" and r.reference_other_render is None
    assert math.isclose(r.normalised, (math.sqrt(0.5) - floor) / (own - floor))
    (r,) = likeness.likeness_report(frames, other, other).collect()
    assert r.normalised_against == "other_render"
    (r,) = likeness.likeness_report(frames).collect()
    assert r.normalised is None and r.normalised_against is None


def test_first_boxes(spark):
    numbers = ("px", "py", "pz", "ex", "ey", "ez", "qx", "qy", "qz", "qw")
    schema = ", ".join(f"{c} double" for c in numbers)
    base = [1.0, 2.0, 3.0, 1.0, 1.0, 1.0, 0.0, 0.6, 0.0, 0.8]
    turned = base[:6] + [-x for x in base[6:]]
    moved = [1.001, *base[1:]]
    close = [1.0005, *base[1:]]
    unknown = [float("nan"), *base[1:]]
    nodes = table(spark, [("c", i, *base) for i in "abcdf"] + [("c", "f", *base)], "clip string, node_id string, " + schema)
    seen = [("c", "a", 1.0, *turned), ("c", "a", 2.0, *moved), ("c", "a", None, *moved), ("c", "b", 0.0, *moved), ("c", "c", 0.0, *unknown), ("c", "d", 0.0, *close), ("c", "f", 0.0, *base), ("c", "g", 0.0, *base)]
    got = {r.object_id: r for r in rules.first_box_comparison(table(spark, seen, "clip string, object_id string, t double, " + schema), nodes).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "matches_first_obb", "b": "changed", "c": "unavailable", "d": "matches_first_obb", "f": "unavailable", "g": "unavailable"}
    assert got["c"].center is None and got["c"].size and got["b"].center is False and got["f"].quat is None


def test_name_arms(spark):
    objects = table(spark, [(1, "Wooden Chair", "a chair"), (2, "lamp", "table"), (3, "dog", None), (4, None, "x")], "o long, truth string, phrase string")
    assets = table(spark, [("c1", "chair_02", "home"), ("l1", "Desk", "lamp-kit"), ("z", "zebra", None)], "asset_id string, name string, kit string")
    ranked = table(spark, [(1, "c1", 1), (2, "z", 1), (2, "l1", 2), (3, "z", 1), (3, "gone", 2), (2, "c1", 6)], "o long, asset_id string, rank int")
    (r,) = retrieval.name_arms(objects, ranked, assets, ["o"]).collect()
    assert tuple(r) == (4, 0.25, 0.25, 0.5)
    (r,) = retrieval.name_arms(objects.limit(0), ranked, assets, ["o"]).collect()
    assert r.n == 0 and r.top is None


def test_dataset_is_written_whole_or_not_at_all(spark, tmp_path):
    doc = lambda c, n=1: json.dumps({"meta": {"clip": c}, "objects": [{"id": f"o{k}", "class": "box"} for k in range(n)]}, indent=1)
    rows = [("a", "f", doc("a")), ("a_style", "f", doc("a_style", 2)), ("bad", "g", doc("bad")), ("bad_behavior", "g", doc("bad_behavior")), ("a", "f", doc("a")), ("a", "h", doc("a", 3)),
            ("_style", "f", doc("_style")), (None, "f", doc("x")), ("empty", "f", None)]
    programs = table(spark, rows, "clip string, family string, program string")
    findings = table(spark, [("bad", "error", "e1"), ("a", "warning", "w1"), ("a", "warning", "w1")], "clip string, severity string, code string")
    path = f"{tmp_path}/out/train"
    told = datasets.write_documents(programs, findings, path, "train", 7)
    status = sorted((str(r.clip), r.status, tuple(r.warnings), tuple(r.errors)) for r in told.collect())
    assert status == sorted([
        ("a", "written", ("w1",), ()), ("a", "duplicate", ("w1",), ()), ("a", "duplicate", ("w1",), ()), ("a_style", "written", (), ()), ("bad", "failed", (), ("e1",)), ("bad_behavior", "written", (), ()),
        ("_style", "written", (), ()), ("None", "failed", (), ("clip_missing",)), ("empty", "failed", (), ("program_missing",))])
    read = scenes.read_programs(spark, f"{path}/programs", lines=True)
    assert sorted((r.clip, r.node_id) for r in read.collect()) == [("_style", "o0"), ("a", "o0"), ("a_style", "o0"), ("a_style", "o1"), ("bad_behavior", "o0")]
    assert [tuple(r) for r in datasets.read_pairs(spark, path).collect()] == [("style_variant", "a", "a_style")]
    (s,) = datasets.read_summary(spark, path).collect()
    assert (s.split, s.seed, s.requested, s.written, s.failed, s.duplicates, s.families) == ("train", 7, 9, 4, 3, 2, ["f", "g", "h"])
    with pytest.raises(FileExistsError):
        datasets.write_documents(programs, findings, path, "train", 7)
    broken = programs.selectExpr("clip", "family", "if(clip = 'a_style', raise_error('lost'), program) AS program")
    with pytest.raises(Exception, match="lost"):
        datasets.write_documents(broken, findings, path, "train", 8, overwrite=True)
    assert datasets.read_summary(spark, path).first().seed == 7 and [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["train"]
    datasets.write_documents(programs.where("clip = 'a_style'"), findings, path, "train", 9, overwrite=True, folders=True)
    assert datasets.read_summary(spark, path).first().written == 1 and (tmp_path / "out/train/programs/clip=a_style").is_dir()
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["train"]


def test_layouts_keep_their_families_rules(spark):
    specs = generation.expand_specs(spark.range(60).withColumnRenamed("id", "number"), "number", "t", 60)
    own = {r.clip: r for r in specs.collect()}
    layouts = {}
    for r in generation.generate_layout(specs).collect():
        layouts.setdefault(r.clip, {})[r.node_id] = r
    assert set(layouts) == set(own)
    counts = {"corridor": (2, 2), "platform": (2, 4), "room": (4, 4), "track": (6, 10), "yard": (1, 3)}
    rails = set()
    for clip, parts in layouts.items():
        family, ground = own[clip].family, parts["ground"]
        assert counts[family][0] <= len(parts) - 1 <= counts[family][1] and ground.py + ground.ey / 2 == 0
        assert 4 <= ground.ex <= 7 and 18 <= ground.ez <= 30 if family == "corridor" else 10 <= ground.ex <= 26
        for name, p in parts.items():
            assert name == "ground" or p.py - p.ey / 2 >= -0.1 and abs(p.px) <= ground.ex / 2 and abs(p.pz) <= ground.ez / 2
        if family == "track":
            ring = sorted(math.atan2(p.pz, p.px) % (2 * math.pi) for n, p in parts.items() if n != "ground")
            assert np.allclose(np.diff([*ring, ring[0] + 2 * math.pi]) % (2 * math.pi), 2 * math.pi / len(ring), atol=5e-3)
            rails.add(len(ring))
        base = f"t_{own[clip].number:06d}"
        assert (ground.ex, ground.ez) == (layouts[base]["ground"].ex, layouts[base]["ground"].ez)  # behaviour does not move the stage
        assert own[clip].kind == "behavior" or {n: tuple(p)[1:] for n, p in parts.items()} == {n: tuple(p)[1:] for n, p in layouts[base].items()}
    assert len(rails) > 2
    objects = generation.generate_in_layout(specs).collect()
    assert len(objects) > 4 * len(own)
    for r in objects:
        parts, reach = layouts[r.clip], math.hypot(r.ex, r.ez) / 2
        ground = parts["ground"]
        assert abs(r.px) + max(reach, r.amp if r.motion in ("trajectory", "prismatic", "periodic_translate") else 0) <= ground.ex / 2 - min(1.5, 0.15 * ground.ex) + 2e-3
        assert abs(r.pz) + reach <= ground.ez / 2 - min(1.5, 0.15 * ground.ez) + 2e-3
        for p in parts.values():
            assert p["class"] in ("ground", "wall") or math.hypot(p.px - r.px, p.pz - r.pz) >= reach + math.hypot(p.ex, p.ez) / 2 - 2e-3
    again = generation.generate_in_layout(specs.where("number < 5").repartition(3)).collect()
    assert set(map(tuple, again)) == {tuple(r) for r in objects if own[r.clip].number < 5}

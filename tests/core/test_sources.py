"""Readers, writers, plug-ins, generation and streams on small files."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sceneloom.functions import plugins
from sceneloom.operators import generation as N
from sceneloom.operators import matching as M
from sceneloom.operators import retrieval as R
from sceneloom.operators import rules
from sceneloom.sources import scenes
from sceneloom.streaming import jobs


def test_programs_states_and_evidence(spark, tmp_path):
    node = {"id": "a", "class": "Crate", "geom": {"kind": "primitive", "shape": "box", "extent": [1, 2, 3]}, "pose": {"pos": [1, 2, 3], "quat": [0, 0, 0, 1]}}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "clip7.json").write_text(json.dumps({"meta": {"duration": 8}, "static": [{**node, "id": "floor", "material": "#ffeedd"}], "objects": [{**node, "motion": {"type": "spin", "rate": 1}, "material": "wood"}, node]}))
    rows = scenes.read_programs(spark, str(tmp_path / "p")).orderBy("grp", "ord").collect()
    assert [(r.clip, r.grp, r.node_id, r.motion_type, r.material_form) for r in rows] == [("clip7", "object", "a", "spin", "palette"), ("clip7", "object", "a", "static", None), ("clip7", "static", "floor", "static", "hex")]
    assert rows[0].px == 1.0 and rows[0].extent == [1.0, 2.0, 3.0]
    (tmp_path / "s").mkdir()
    line = {"t": 0.5, "camera": {"pos": [0, 1, 2], "quat": [0, 0, 0, 1]}, "objects": [{"id": "a", "name": "a#1", "pos": [1, 1, 1], "quat": [0, 0, 0, 1]}]}
    (tmp_path / "s" / "c1.jsonl").write_text(json.dumps(line) + "\n\n" + json.dumps({**line, "t": 1.0}) + "\n")
    states, cameras = scenes.read_states(spark, str(tmp_path / "s"))
    assert [(r.clip, r.instance_key, r.t) for r in states.orderBy("t").collect()] == [("c1", "a#1", 0.5), ("c1", "a#1", 1.0)] and cameras.count() == 2
    (tmp_path / "e").mkdir()
    doc = {"meta": {"clip": "c"}, "frames": [{"frame_index": 0, "t": 0}], "objects": [{"id": "x", "confidence": "unknown", "observations": [{"frame_index": 0, "t": 0, "bbox": [1, 2, 3, 4], "visible_fraction": "unknown"}, {"frame_index": 1, "t": 1, "bbox": "unknown", "visible_fraction": 0.5}], "obb": []}]}
    (tmp_path / "e" / "c.json").write_text(json.dumps(doc))
    ev = scenes.read_evidence(spark, str(tmp_path / "e"))
    o = ev["ev_objects"].first()
    assert o.confidence is None and o.track_id == "x" and [r.code for r in ev["findings"].collect()] == ["legacy_track_id"]
    assert [(r.bbox, r.visible_fraction) for r in ev["ev_observations"].orderBy("ord").collect()] == [([1.0, 2.0, 3.0, 4.0], None), (None, 0.5)]


def test_catalog_logs_runs_and_hashes(spark, tmp_path):
    (tmp_path / "3d" / "train" / "sub").mkdir(parents=True)
    (tmp_path / "3d" / "train" / "sub" / "loco.glb").write_bytes(b"x")
    (tmp_path / "3d" / "misc").mkdir()
    (tmp_path / "3d" / "misc" / "ball-red.glb").write_bytes(b"y")
    (tmp_path / "titles.tsv").write_text("train\tTrain Kit\n")
    got = {r.asset_id: r.kit_title for r in scenes.read_catalog(spark, str(tmp_path), str(tmp_path / "titles.tsv")).collect()}
    assert got == {"train/loco": "Train Kit", "misc/ball-red": "misc"}
    (tmp_path / "log.jsonl").write_text('{"time":1,"stage":"a","code":"x"}\n{"time":2,"stage":"a","code":"x"}\n')
    assert scenes.read_error_log(spark, str(tmp_path / "log.jsonl")).first().n == 2
    runs, report = scenes.read_runs(spark.createDataFrame([("r/test_1", None), ("r/test_1", None), ("q", "c")], "run string, clip string"))
    assert {r.run: r.clip for r in runs.collect()} == {"r/test_1": "test_1", "q": "c"} and report.first().duplicates == 1
    docs = spark.createDataFrame([('{"b": 1, "a": [2, 1]}',), ('{"a":[2,1],"b":1}',), ('{"a":[1,2],"b":1}',), ("{",)], "d string").select(scenes.content_hash(F.col("d")).alias("h"))
    h = [r.h for r in docs.collect()]
    assert h[0] == h[1] != h[2] and h[3] is None
    clips = spark.createDataFrame([(1, "test", "room"), (2, "train", "room")], "clip int, split string, family string")
    scenes.write_dataset(clips, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'test'").count() == 1


def test_edits_are_judged_by_path_with_tolerance(spark):
    leaves = lambda x: rules.flatten_json(spark, spark.createDataFrame([("k", json.dumps(x))], "k string, d string"), "k", "d")
    before, wanted = {"a": {"b/c": 1}, "l": [1, 2]}, {"a": {"b/c": 2}, "l": [1, 2]}
    assert {r.path for r in leaves(before).collect()} == {"/a/b~1c", "/l/0", "/l/1"}
    good = rules.edit_judgement(leaves(before), leaves({"a": {"b/c": 2 + 1e-9}, "l": [1, 2]}), leaves(wanted)).first()
    bad = rules.edit_judgement(leaves(before), leaves({"a": {"b/c": 2}, "l": [1]}), leaves(wanted)).first()
    assert good.passed and good.changed == 1 and not bad.passed and bad.wrong == 1


def test_support_cycles_are_found(spark):
    refs = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a"), ("c", "x", "a"), ("c", "y", "z")], "clip string, node_id string, target string")
    assert {r.path for r in rules.support_cycles(refs).collect()} == {"a", "b", "x"}


def test_generation_is_a_function_of_the_spec(spark):
    specs = N.expand_specs(spark.range(6).withColumnRenamed("id", "number"), "number", "test", 2)
    rows = specs.collect()
    base, style, behave = ({r.number: r for r in rows if r.kind == k} for k in ("base", "style", "behavior"))
    assert len(rows) == 10
    for n in (0, 1):
        assert style[n].behavior_seed == base[n].behavior_seed and style[n].style_seed != base[n].style_seed
        assert behave[n].style_seed == base[n].style_seed and behave[n].behavior_seed != base[n].behavior_seed
    scenes_ = lambda s: {(r.clip, r.node): tuple(r)[2:] for r in N.generate_scenes(s).collect()}
    every, some = scenes_(specs), scenes_(specs.where("number = 1"))
    assert all(every[k] == v for k, v in some.items())
    assert every["test_000000", 0] == every["test_000000_s", 0] and any(every["test_000000", i] != every["test_000000_b", i] for i in range(5))
    many = N.generate_scenes(N.expand_specs(spark.range(300).withColumnRenamed("id", "number"), "number", "t", 0))
    assert {r.motion for r in many.select("motion").distinct().collect()} == {m for m, _ in N.MOTIONS}
    assert many.where("abs(px) + amp > 4.001 AND motion IN ('trajectory', 'prismatic')").count() == 0


def test_stream_equals_batch_and_late_frames_change_nothing(spark, tmp_path):
    rows = [(1, 100 * f + k, f, "crate", 0.9, 40.0 * k + f, 0.0, 40.0 * k + f + 10, 10.0) for f in range(40) for k in range(3)]
    schema = "clip long, detection_id long, frame int, label string, score double, x1 double, y1 double, x2 double, y2 double"
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds((F.col("frame") + 1000) * 3600))
    for i, (lo, hi) in enumerate([(0, 10), (10, 25), (25, 40)]):
        table.where((F.col("frame") >= lo) & (F.col("frame") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table.where("frame = 3").withColumn("detection_id", F.col("detection_id") + 50).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), 1)
    got = jobs.drain(jobs.associate_stream(stream, delay="60 hours"), f"file://{tmp_path}/out").collect()
    want = {r.detection_id: r.track_id for r in M.associate(spark.createDataFrame(rows, schema)).collect()}
    assert {r.detection_id: r.track_id for r in got if r.code != "late"} == want
    assert sorted(r.detection_id for r in got if r.code == "late") == [350, 351, 352]


def test_plugins_must_keep_their_schema(spark):
    frames = spark.createDataFrame([("c", 0), ("c", 1)], "clip string, frame int")

    def good(parts):
        for pdf in parts:
            yield pd.DataFrame({"clip": pdf["clip"], "object_id": "o", "frame": pdf["frame"], "u": 1, "v": 2})

    assert plugins.apply_plugin(frames, good, plugins.SEGMENTATION).count() == 2
    with pytest.raises(Exception, match="plug-in gave columns"):
        plugins.apply_plugin(frames, lambda parts: (p for p in parts), plugins.SEGMENTATION).count()


def test_text_admits_and_images_only_reorder(spark):
    """An image score moves what the words admit, and never brings in what they do not."""
    rows = [("harbour/boat", "rowing-boat", "harbour", "Harbour Set"), ("harbour/pier", "pier-plank", "harbour", "Harbour Set"), ("attic/boat", "boat-in-bottle", "attic", "Attic Finds"),
            ("attic/lantern", "stormLantern", "attic", "Attic Finds"), ("yard/wheel", "wheel-iron", "yard", "Yard Parts")]
    assets = spark.createDataFrame(rows, "asset_id string, name string, kit string, kit_title string")
    scored = R.score_assets(spark.createDataFrame([("boat",), ("storm lantern",), ("violin",)], "query string"), assets)
    best = {r.query: r.asset_id for r in R.retrieve(scored, None, 1).collect()}
    assert best == {"boat": "harbour/boat", "storm lantern": "attic/lantern"}
    text = {r.asset_id: r.score for r in scored.where("query = 'boat'").collect()}
    assert text["harbour/boat"] > text["attic/boat"] > 0 and "yard/wheel" not in text
    images = spark.createDataFrame([("boat", "attic/boat", 1.0), ("boat", "yard/wheel", 1.0), ("violin", "yard/wheel", 1.0)], "query string, asset_id string, image double")
    got = [(r.asset_id, r.score) for r in R.retrieve(scored.where("query = 'boat'"), images, 5).orderBy("rank").collect()]
    assert got[0] == ("attic/boat", text["attic/boat"]) and {a for a, _ in got} == set(text)

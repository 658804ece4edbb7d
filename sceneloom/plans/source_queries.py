"""Readers and writers over the given tables: tables are written in the formats of scene corpora below the shared folder and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions import plugins
from sceneloom.functions.columns import r6
from sceneloom.plans.adapters import NODES, STATES, nodes, states, table
from sceneloom.plans.registry import query
from sceneloom.shared import shared_path
from sceneloom.sources import scenes


def _written(rows: DataFrame, document: Column, name: str, by: str | None = None) -> str:
    """Path of a folder of JSON lines with a document per row."""
    path = shared_path(rows.sparkSession, name)
    lines = rows.select(*([by] if by else []), F.to_json(document).alias("value"))
    if by:
        lines.repartition(by).write.partitionBy(by).text(path)
    else:
        lines.write.text(path)
    return path


@query(f"""WITH {NODES} SELECT clip::VARCHAR AS clip, 'run-' || clip AS run, grp, class || '#' || node AS node_id, class, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, round(ex, 6) AS ex, CASE WHEN node % 3 = 0 THEN 'spin' ELSE 'static' END AS motion_type,
  CASE node % 4 WHEN 0 THEN NULL WHEN 1 THEN 'hex' WHEN 2 THEN 'surface' ELSE 'palette' END AS material_form FROM nodes""")
def s1_read_programs(spark, d):
    """Every clip's nodes as a program document, read back as nodes."""
    motion = F.when(F.col("node") % 3 == 0, F.struct(F.lit("spin").alias("type"), F.lit(90.0).alias("rate")))
    material = F.array(F.lit(None).cast("string"), F.lit("#a0b0c0"), F.lit('{"base_color":"#ffffff"}'), F.lit("oak"))[F.expr("cast(node % 4 AS int)")]
    node = F.struct(
        F.concat_ws("#", "class", F.col("node").cast("string")).alias("id"), F.col("class"), F.struct(F.lit("primitive").alias("kind"), F.lit("box").alias("shape"), F.array("ex", "ey", "ez").alias("extent")).alias("geom"),
        F.struct(F.array("px", "py", "pz").alias("pos")).alias("pose"), material.alias("material"), motion.alias("motion"),
    )
    member = lambda g: F.array_sort(F.collect_list(F.when(F.col("grp") == g, F.struct("node", node.alias("n")))))
    docs = nodes(spark, d).groupBy("clip").agg(member("static").alias("s"), member("object").alias("o"))
    meta = F.struct(F.col("clip").cast("string").alias("clip"), F.concat(F.lit("run-"), F.col("clip").cast("string")).alias("run"))
    path = _written(docs, F.struct(meta.alias("meta"), F.col("s.n").alias("static"), F.col("o.n").alias("objects")), "programs")
    read = scenes.read_programs(spark, path, lines=True)
    return read.select("clip", "run", "grp", "node_id", "class", r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"), r6(F.col("pz")).alias("pz"), r6(F.col("extent")[0]).alias("ex"), "motion_type", "material_form")


@query(f"""WITH {STATES} SELECT clip::VARCHAR AS clip, instance AS instance_key, CASE WHEN event_id % 5 = 0 THEN instance ELSE instance || '_id' END AS object_id, round(t, 3) AS t, round(x, 6) AS px, round(y, 6) AS py, 0::DOUBLE AS pz FROM states""")
def s2_read_states(spark, d):
    """Every event as a frame of its clip's state log, a folder per clip."""
    own = F.when(F.col("event_id") % 5 != 0, F.col("instance"))
    one = F.struct(F.when(own.isNull(), F.col("instance")).otherwise(F.concat("instance", F.lit("_id"))).alias("id"), own.alias("name"), F.array("x", "y", F.lit(0.0)).alias("pos"))
    doc = F.struct("t", F.struct(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("pos")).alias("camera"), F.array(one).alias("objects"))
    read, _ = scenes.read_states(spark, _written(states(spark, d), doc, "states", "clip"), r"clip=([^/]+)/")
    return read.select("clip", "instance_key", "object_id", F.round("t", 3).alias("t"), r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"), "pz")


_EVIDENCE = f"""{STATES}, o AS (SELECT clip, instance, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0) AS unknown, round(avg(CASE WHEN event_id % 4 <> 0 THEN x / 100 END), 6) AS visible FROM states GROUP BY ALL)"""


def _evidence(spark, d):
    s = states(spark, d)
    seen = F.struct(F.col("event_id").cast("int").alias("frame_index"), "t", F.array("x", "y", F.expr("x + 30"), F.expr("y + 40")).alias("bbox"), F.when(F.col("event_id") % 4 == 0, "unknown").otherwise((F.col("x") / 100).cast("string")).alias("visible_fraction"))
    one = s.groupBy("clip", "instance").agg(F.array_sort(F.collect_list(seen)).alias("observations"))
    track = F.when(F.length("instance") % 2 == 0, F.concat(F.lit("t-"), "instance"))
    sure = F.when(F.col("clip") % 3 == 0, F.lit("unknown")).when(F.col("clip") % 3 == 1, F.lit("0.5"))
    objects = F.array_sort(F.collect_list(F.struct(F.col("instance").alias("id"), track.alias("track_id"), sure.alias("confidence"), "observations")))
    docs = one.groupBy("clip").agg(objects.alias("objects"))
    doc = F.struct(F.struct(F.col("clip").cast("string").alias("clip")).alias("meta"), F.array(F.struct(F.lit(0).alias("frame_index"), F.when(F.col("clip") % 2 == 0, 0.0).alias("t"))).alias("frames"), "objects")
    return scenes.read_evidence(spark, _written(docs, doc, "evidence"), lines=True)


@query(f"""WITH {_EVIDENCE} SELECT clip::VARCHAR AS clip, instance AS object_id, CASE WHEN length(instance) % 2 = 0 THEN 't-' || instance ELSE instance END AS track_id, CASE WHEN clip % 3 = 1 THEN 0.5::DOUBLE END AS confidence, n AS observations, unknown, visible FROM o""")
def s3_read_evidence(spark, d):
    """Evidence documents of all clips: unknown is null, an object without a track is its own."""
    ev = _evidence(spark, d)
    seen = ev["ev_observations"].groupBy("clip", "object_id").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("visible_fraction").isNull()).alias("unknown"), r6(F.avg("visible_fraction")).alias("visible"))
    return ev["ev_objects"].select("clip", "object_id", "track_id", "confidence").join(seen, ["clip", "object_id"])


@query(f"""WITH {_EVIDENCE}, f AS (SELECT 'legacy_track_id' AS code FROM o WHERE length(instance) % 2 = 1 UNION ALL SELECT 'legacy_confidence' FROM o WHERE clip % 3 = 2 UNION ALL SELECT 'legacy_frame_time' FROM (SELECT DISTINCT clip FROM o) WHERE clip % 2 = 1)
SELECT code, 'warning' AS severity, count(*) AS n FROM f GROUP BY ALL""")
def s3_legacy_findings(spark, d):
    return _evidence(spark, d)["findings"].groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT replace(p_brand, '#', '-') || '/' || p_partkey AS asset_id, replace(p_brand, '#', '-') AS kit, p_partkey::VARCHAR AS name, CASE WHEN right(p_brand, 1) IN ('1', '2', '3') THEN 'Kit ' || replace(p_brand, '#', '-') ELSE replace(p_brand, '#', '-') END AS kit_title FROM part""")
def s5_read_catalog(spark, d):
    """A listing of asset files; two kits in five have no title."""
    kit = F.regexp_replace("p_brand", "#", "-")
    part = table(spark, d, "part")
    files = part.select(F.concat(F.lit("file:/library/3d/"), kit, F.lit("/models/"), F.col("p_partkey").cast("string"), F.lit(".glb")).alias("path"))
    titles = part.where(F.substring("p_brand", -1, 1).isin("1", "2", "3")).select(kit.alias("kit"), F.concat(F.lit("Kit "), kit).alias("kit_title")).distinct()
    return scenes.catalog_of(files, titles).select("asset_id", "kit", "name", "kit_title")


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS clip, CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'f' || (o_custkey % 3) AS family, o_orderkey FROM orders),
t AS (SELECT *, CASE WHEN clip IS NULL THEN 'skipped' WHEN row_number() OVER (PARTITION BY clip ORDER BY split, family, o_orderkey) > 1 THEN 'duplicate' ELSE 'written' END AS status FROM c)
SELECT status, split, family, count(*) AS n, CASE WHEN status = 'written' THEN count(*) ELSE 0 END AS read_back FROM t GROUP BY status, split, family""")
def s6_write_dataset(spark, d):
    """Orders as clips of a dataset: what was written, skipped or listed twice, and what a reader finds."""
    split = F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train")
    clips = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("clip"), split.alias("split"), F.concat(F.lit("f"), F.expr("cast(o_custkey % 3 AS string)")).alias("family"), "o_orderkey")
    path = shared_path(spark, "dataset")
    told = scenes.write_dataset(clips, path).groupBy("status", "split", "family").agg(F.count(F.lit(1)).alias("n"))
    read = spark.read.parquet(path).groupBy("split", "family").agg(F.count(F.lit(1)).alias("read_back")).withColumn("status", F.lit("written"))
    return told.join(read, ["status", "split", "family"], "left").na.fill(0, ["read_back"])


@query(f"""WITH {STATES} SELECT clip::VARCHAR AS clip, 'd' || event_id AS detection_id, (event_id % 100000)::INTEGER AS frame_index, instance AS class_label, round(x / 100, 6) AS score, round(x, 6) AS x1, round(y, 6) AS y1, round(x + 30, 6) AS x2, round(y + 40, 6) AS y2 FROM states WHERE x >= 10""")
def u1_apply_plugin(spark, d):
    """A detector as a plug-in over batches of frames; it drops faint objects."""
    def detect(parts):
        for pdf in parts:
            p = pdf[pdf["x"] >= 10]
            yield pd.DataFrame({"clip": p["clip"], "detection_id": "d" + p["event_id"].astype(str), "frame_index": (p["event_id"] % 100_000).astype("int32"), "class_label": p["instance"], "score": p["x"] / 100,
                                "x1": p["x"], "y1": p["y"], "x2": p["x"] + 30, "y2": p["y"] + 40})

    frames = states(spark, d).select(F.col("clip").cast("string").alias("clip"), "instance", "event_id", "x", "y")
    out = plugins.apply_plugin(frames, detect, plugins.DETECTION)
    return out.select("clip", "detection_id", "frame_index", "class_label", *[r6(F.col(c)).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])

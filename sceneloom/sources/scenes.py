"""Readers and writers of scene documents, frame states, evidence, catalogs, runs and logs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

GEOM = "struct<kind:string,shape:string,extent:array<double>,size:array<double>,radius:double,radius_top:double,radius_bottom:double,height:double,axis:string,query:string,ref:string>"
POSE = "struct<pos:array<double>,quat:array<double>>"
KEYFRAMES = "array<struct<t:double,pos:array<double>,quat:array<double>>>"
NODE = f"struct<id:string,class:string,geom:{GEOM},pose:{POSE},instances:array<{POSE}>,support:string,confidence:double,grab:string,material:string,motion:struct<type:string,keyframes:{KEYFRAMES},axis:array<double>,period:double,amp:double,rate:double>>"
PROGRAM = f"meta struct<clip:string,run:string,duration:double,fps:double>, static array<{NODE}>, objects array<{NODE}>"
STATE = f"t double, camera struct<pos:array<double>,quat:array<double>>, objects array<struct<id:string,name:string,kind:string,class:string,pos:array<double>,quat:array<double>>>"
ERROR_LOG = "time double, stage string, code string, message string, recoverable boolean, action_taken string"
EVIDENCE = (
    "meta struct<clip:string,duration:double>, frames array<struct<frame_index:int,t:double>>, objects array<struct<id:string,track_id:string,class_guess:string,confidence:string,"
    "observations:array<struct<frame_index:int,t:double,bbox:string,visible_fraction:string>>,obb:array<struct<t:double,center:array<double>,size:array<double>>>>>"
)


def read_programs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scene documents as nodes, static ones first; absent motion is static, the clip defaults to the file's name.

    A file holds one document, or with ``lines`` one in each line, as large corpora do; files of lines can be split."""
    docs = spark.read.schema(PROGRAM).option("multiLine", not lines).json(path)
    docs = docs.withColumn("clip", F.coalesce("meta.clip", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)))
    parts = [docs.select("clip", F.col("meta.run").alias("run"), F.lit(g).alias("grp"), F.posexplode(c).alias("ord", "n")) for g, c in (("static", "static"), ("object", "objects"))]
    n = parts[0].unionByName(parts[1])
    return n.select(
        "clip", "run", "grp", "ord", F.col("n.id").alias("node_id"), F.col("n.class").alias("class"), "n.geom.*", *[F.get(F.col("n.pose.pos"), i).alias(c) for i, c in enumerate(("px", "py", "pz"))],
        *[F.get(F.col("n.pose.quat"), i).alias(c) for i, c in enumerate(("qx", "qy", "qz", "qw"))], F.coalesce("n.motion.type", F.lit("static")).alias("motion_type"), "n.support", "n.confidence", "n.grab",
        F.when(F.col("n.material").startswith("#"), "hex").when(F.col("n.material").startswith("{"), "surface").when(F.col("n.material").isNotNull(), "palette").alias("material_form"), F.col("n.material").alias("material"),
        "n.instances", F.col("n.motion.keyframes").alias("keyframes"),
    )


def read_states(spark: SparkSession, path: str, clip_pattern: str = r"([^/]+)\.jsonl$") -> tuple[DataFrame, DataFrame]:
    """Frame states (JSON lines) as instance rows and camera rows; the clip comes from the file's name, blank lines are skipped."""
    lines = spark.read.schema(STATE).json(path).withColumn("clip", F.regexp_extract(F.col("_metadata.file_path"), clip_pattern, 1)).where("t IS NOT NULL")
    o = lines.select("clip", "t", F.explode_outer("objects").alias("o")).where("o IS NOT NULL")
    at = lambda c, names: [F.get(F.col(c), i).alias(n) for i, n in enumerate(names)]
    states = o.select("clip", "t", F.coalesce("o.name", "o.id").alias("instance_key"), F.col("o.id").alias("object_id"), "o.kind", "o.class", *at("o.pos", ("px", "py", "pz")), *at("o.quat", ("qx", "qy", "qz", "qw")))
    return states, lines.select("clip", "t", *at("camera.pos", ("px", "py", "pz")))


def known(c: str | Column) -> Column:
    """A number, or null where the document says unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "unknown", c.try_cast("double"))


def read_evidence(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Evidence documents as frames, objects, observations and boxes; ``unknown`` becomes null, never a number.

    Documents of the old form are adapted, with a warning row for each adaptation: an object without a track id is its own track, one
    whose confidence is missing is of unknown confidence, a frame without a time has none. With ``lines`` a file holds a document a line.
    """
    docs = spark.read.schema(EVIDENCE).option("multiLine", not lines).json(path)
    docs = docs.withColumn("clip", F.coalesce("meta.clip", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)))
    objects = docs.select("clip", F.posexplode("objects").alias("ord", "o"))
    return {
        "ev_frames": docs.select("clip", F.explode("frames").alias("f")).select("clip", "f.*"),
        "ev_objects": objects.select("clip", "ord", F.col("o.id").alias("object_id"), F.coalesce("o.track_id", "o.id").alias("track_id"), "o.class_guess", known("o.confidence").alias("confidence")),
        "ev_observations": objects.select("clip", F.col("o.id").alias("object_id"), F.posexplode("o.observations").alias("ord", "v")).select(
            "clip", "object_id", "ord", "v.frame_index", "v.t", F.from_json(F.when(F.col("v.bbox") != "unknown", F.col("v.bbox")), "array<double>").alias("bbox"), known("v.visible_fraction").alias("visible_fraction")),
        "ev_obb": objects.select("clip", F.col("o.id").alias("object_id"), F.posexplode("o.obb").alias("ord", "b")).select("clip", "object_id", "ord", "b.*"),
        "findings": _adapted(docs, objects),
    }


def _adapted(docs: DataFrame, objects: DataFrame) -> DataFrame:
    """A warning for each adaptation of an old document; several of one object are several rows."""
    missing = [("legacy_track_id", F.col("o.track_id").isNull()), ("legacy_confidence", F.col("o.confidence").isNull())]
    found = F.filter(F.array(*[F.when(lacks, F.lit(code)) for code, lacks in missing]), lambda c: c.isNotNull())
    told = objects.select("clip", F.explode(found).alias("code"), F.col("o.id").alias("path"))
    frames = docs.select("clip", F.explode("frames").alias("f")).where("f.t IS NULL").select("clip", F.lit("legacy_frame_time").alias("code"), F.col("f.frame_index").cast("string").alias("path"))
    return told.unionByName(frames).select("clip", F.lit("evidence").alias("stage"), F.lit("warning").alias("severity"), "code", "path")


def read_runs(runs: DataFrame, key: str = "run") -> tuple[DataFrame, DataFrame]:
    """Distinct runs, and one row that counts what was listed more than once. A run without a clip takes it from its name."""
    if "clip" in runs.columns:
        runs = runs.withColumn("clip", F.coalesce(F.col("clip").cast("string"), F.nullif(F.regexp_extract(F.col(key).cast("string"), "(test_.*)$", 1), F.lit(""))))
    counted = runs.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in runs.columns if c != key])
    return counted.drop("__n"), counted.agg(F.count(F.lit(1)).alias("runs"), (F.sum("__n") - F.count(F.lit(1))).alias("duplicates"))


def read_catalog(spark: SparkSession, root: str, titles: str | None = None) -> DataFrame:
    """Assets below ``root`` as ``3d/<kit>/**/<name>.glb``: only paths are read, titles come from a TSV (missing: the kit's slug)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").option("recursiveFileLookup", True).load(root).select("path")
    return catalog_of(files, None if titles is None else spark.read.schema("kit string, kit_title string").option("sep", "\t").csv(titles))


def catalog_of(files: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Assets of a listing ``files(path)``, with the titles of their kits; a kit without one keeps its slug."""
    a = files.select("path", F.regexp_extract("path", r"/3d/([^/]+)/", 1).alias("kit"), F.regexp_extract("path", r"([^/]+)\.glb$", 1).alias("name")).where("kit <> ''")
    a = a.withColumn("asset_id", F.concat_ws("/", "kit", "name"))
    if titles is None:
        return a.withColumn("kit_title", F.col("kit"))
    return a.join(titles, "kit", "left").withColumn("kit_title", F.coalesce("kit_title", "kit"))


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """Counts of an append-only error log by stage and code."""
    return error_counts(spark.read.schema(ERROR_LOG).json(path))


def error_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n"))


def write_dataset(clips: DataFrame, path: str, parts: tuple[str, ...] = ("split", "family"), key: str = "clip") -> DataFrame:
    """Clips as Parquet, partitioned by split and family; returns one row per clip with what became of it.

    A clip that lacks its key or a part is ``skipped``, one listed before (in the order of all columns) is a ``duplicate``, the rest is ``written``; rows
    of a partition are spread by the key, so a large one is many files.
    """
    lacks = F.lit(False)
    for c in (key, *parts):
        lacks = lacks | F.col(c).isNull()
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in clips.columns]))
    told = clips.withColumn("status", F.when(lacks, "skipped").when(nth > 1, "duplicate").otherwise("written"))
    told.where("status = 'written'").drop("status").repartition(*parts, F.pmod(F.xxhash64(key), F.lit(4))).write.mode("overwrite").partitionBy(*parts).parquet(path)
    return told.select(key, *parts, "status")


def write_report(report: DataFrame, path: str) -> None:
    """A small evaluation report as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces, array order kept; null if it cannot be read."""
    def one(x):
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)


def content_hash(document: Column) -> Column:
    """SHA-256 of a document's canonical form."""
    return F.sha2(canonical_json(document).cast("binary"), 256)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()

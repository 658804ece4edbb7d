"""A generated dataset as documents: a scene document per clip, a manifest and the pairs of variants, all or nothing (S6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the name of a variant adds to that of its base, and the kind of pair they make.
VARIANTS = {"_style": "style_variant", "_behavior": "behavior_variant"}
PARTS = ("programs", "manifest", "pairs", "summary")
#: Tables of rows below a dataset and their columns.
MANIFEST = "clip string, family string, status string, sha256 string, warnings array<string>, errors array<string>"
PAIRS = "kind string, base string, variant string"
SUMMARY = "split string, seed long, requested long, written long, failed long, duplicates long, families array<string>"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def told_of(programs: DataFrame, findings: DataFrame) -> DataFrame:
    """Programs with ``status``, ``warnings`` and ``errors``: ``failed`` with an error among ``findings(clip, severity, code)``, ``duplicate`` if a
    document of the clip came before (in the order of family and text), else ``written``. Without a clip or text a document has failed."""
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("code"))))
    found = findings.groupBy("clip").agg(of("warning").alias("warnings"), of("error").alias("errors"))
    empty = F.array().cast("array<string>")
    rows = programs.select("clip", "family", "program").join(found, "clip", "left")
    lacks = F.when(F.col("clip").isNull(), F.array(F.lit("clip_missing"))).when(F.col("program").isNull(), F.array(F.lit("program_missing"))).otherwise(empty)
    rows = rows.withColumns({"warnings": F.coalesce("warnings", empty), "errors": F.concat(F.coalesce("errors", empty), lacks)})
    # Equal texts of a clip are one document; a group holds the texts of one clip's documents only.
    counted = rows.groupBy("clip", "family", "program", "warnings", "errors").agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("sha256", F.sha2(F.col("program").cast("binary"), 256))
    first = counted.where("clip IS NOT NULL AND size(errors) = 0").groupBy("clip").agg(F.min(F.struct("family", "sha256")).alias("__first"))
    judged = counted.join(first, "clip", "left").withColumn("__own", F.struct("family", "sha256").eqNullSafe(F.col("__first")))
    nth = judged.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    status = F.when(F.size("errors") > 0, "failed").when(F.col("__own") & (F.col("__nth") == 1), "written").otherwise("duplicate")
    return nth.withColumn("status", status).select("clip", "family", "program", "status", "sha256", "warnings", "errors")


def variant_pairs(clips: DataFrame) -> DataFrame:
    """``kind, base, variant`` of clips whose name is that of another one and a variant's ending."""
    kinds = F.expr(" ".join(["CASE", *[f"WHEN endswith(clip, '{e}') THEN '{k}'" for e, k in VARIANTS.items()], "END"]))
    ends = "|".join(VARIANTS)
    made = clips.select(F.col("clip").alias("variant"), kinds.alias("kind"), F.regexp_replace("clip", f"({ends})$", "").alias("base")).where("kind IS NOT NULL")
    return made.join(clips.select(F.col("clip").alias("base")), "base", "left_semi").select("kind", "base", "variant")


def write_documents(programs: DataFrame, findings: DataFrame, path: str, split: str, seed: int, overwrite: bool = False, folders: bool = False) -> DataFrame:
    """Write the documents that have no error below ``path``; returns the manifest as read back from there.

    ``programs(clip, family, program)``: scene documents as text. ``programs/`` holds a document a line (with ``folders`` a folder per clip,
    ``clip=<clip>/``, for datasets of which each clip is opened by itself), ``manifest/`` a row per document asked for,
    ``pairs/`` base and variant, ``summary/`` one row of counts. All is written beside ``path`` first and moved there at the end, so a reader finds the whole
    dataset or none; what a failed run wrote is deleted. A path that exists is refused unless ``overwrite``.
    """
    spark = programs.sparkSession
    target, fs = _hadoop(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    beside = f"{path.rstrip('/')}-writing-{uuid.uuid4().hex[:12]}"
    staging, _ = _hadoop(spark, beside)
    try:
        told_of(programs, findings).write.parquet(f"{beside}/_told")
        told = spark.read.parquet(f"{beside}/_told")
        written = told.where("status = 'written'")
        lines = written.select("clip", F.regexp_replace("program", r"\s*[\r\n]\s*", " ").alias("value"))
        if folders:
            lines.repartition("clip").write.partitionBy("clip").text(f"{beside}/programs")
        else:
            lines.select("value").write.text(f"{beside}/programs")
        told.drop("program").write.json(f"{beside}/manifest")
        variant_pairs(written.select("clip")).write.json(f"{beside}/pairs")
        counts = told.agg(
            F.lit(split).alias("split"), F.lit(seed).cast("long").alias("seed"), F.count(F.lit(1)).alias("requested"), *[F.count_if(F.col("status") == s).alias(n) for s, n in
            (("written", "written"), ("failed", "failed"), ("duplicate", "duplicates"))], F.array_sort(F.collect_set("family")).alias("families"),
        )
        counts.coalesce(1).write.json(f"{beside}/summary")
        fs.delete(_hadoop(spark, f"{beside}/_told")[0], True)
        fs.mkdirs(target.getParent())
        before, replaced = _hadoop(spark, f"{beside}-before")[0], fs.exists(target)
        if replaced and not fs.rename(target, before) or not fs.rename(staging, target):
            if replaced and not fs.exists(target):
                fs.rename(before, target)
            raise OSError(f"cannot move {beside} to {path}")
        fs.delete(before, True)
    except BaseException:
        fs.delete(staging, True)
        raise
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).json(f"{path}/pairs")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(f"{path}/summary")

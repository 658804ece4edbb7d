"""Projections of the given tables to canonical ones, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Scene nodes: clip, node (ordinal), class, grp, position, extent; one per order line; ``more`` are added columns of the lines."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    # Numbered before anything is renamed: only the lines' own columns are shuffled, and what follows by clip finds its rows together.
    return li.withColumn("__node", F.row_number().over(order).cast("long")).select(
        F.col("l_orderkey").alias("clip"), F.col("__node").alias("node"), F.col("l_returnflag").alias("class"),
        F.when(F.col("l_linestatus") == "F", "static").otherwise("object").alias("grp"),
        F.col("l_quantity").alias("px"), (10 * F.col("l_discount")).alias("py"), (10 * F.col("l_tax")).alias("pz"),
        (F.col("l_quantity") / 10).alias("ex"), (0.1 + F.col("l_discount")).alias("ey"), (0.1 + F.col("l_tax")).alias("ez"), *more,
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reconstruction might have found of the nodes: some dropped, the rest shifted and resized."""
    return nodes(spark, sf_dir).where("(clip + node) % 5 <> 0").withColumns({
        "px": F.expr("px + 0.1D * (node % 3)"), "pz": F.expr("pz + 0.05D * (node % 2)"), "ex": F.expr("ex * (1 + 0.25D * (node % 4))"),
        "class": F.expr("CASE WHEN node % 7 = 0 THEN 'X' ELSE class END"),
    })


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses over time: clip, instance, t (seconds), x, y, one row per event."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("clip"), F.col("event_type").alias("instance"), F.col("event_id"), F.expr("unix_micros(cast(convert_timezone('UTC', current_timezone(), cast(ts AS timestamp_ntz)) AS timestamp)) / 1e6D").alias("t"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"),
    )


NODES = """nodes AS (SELECT l_orderkey AS clip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS node,
  l_returnflag AS class, CASE WHEN l_linestatus = 'F' THEN 'static' ELSE 'object' END AS grp, l_quantity AS px, 10 * l_discount AS py, 10 * l_tax AS pz,
  l_quantity / 10 AS ex, 0.1::DOUBLE + l_discount AS ey, 0.1::DOUBLE + l_tax AS ez FROM lineitem)"""
PREDICTIONS = NODES + """,
predictions AS (SELECT clip, node, CASE WHEN node % 7 = 0 THEN 'X' ELSE class END AS class, grp, px + 0.1::DOUBLE * (node % 3) AS px, py, pz + 0.05::DOUBLE * (node % 2) AS pz,
  ex * (1 + 0.25::DOUBLE * (node % 4)) AS ex, ey, ez FROM nodes WHERE (clip + node) % 5 <> 0)"""
STATES = """states AS (SELECT user_id AS clip, event_type AS instance, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, value AS x,
  regexp_extract(props, '(-?[0-9]+)', 1)::DOUBLE AS y FROM events)"""

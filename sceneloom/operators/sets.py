"""Top-k, set comparison and shards, each under a complete order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.numbering import numbered_in_order


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the order must be complete for the result to be one."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def compare_sets(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with where they are: both, missing or extra."""
    e, s = expected.select(keys).distinct().withColumn("__e", F.lit(1)), seen.select(keys).distinct().withColumn("__s", F.lit(1))
    where = F.when(F.col("__s").isNull(), "missing").when(F.col("__e").isNull(), "extra").otherwise("both")
    return e.join(s, keys, "full").select(*keys, where.alias("status"))


def shards(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Row i in the order goes to shard i mod n. Rows are numbered by a range-partitioned sort, so no task numbers them all."""
    return numbered_in_order(rows, order, "__i").withColumn("shard", (F.col("__i") % n).cast("int")).drop("__i")

"""Running sums over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.shared import null_safe_join, stored, with_lookup

#: Rows that one slice of a group aims at.
ROWS_PER_SLICE = 2_000
#: Slices that are summed together before the sums are run over.
SLICES_PER_BLOCK = 4_096


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text; null hashes like the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix_sums(sums: DataFrame, group: list[str], order: str, value: str, into: str, block: int = SLICES_PER_BLOCK) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the group with a smaller ``order`` (a long), in two levels.

    Blocks of neighbouring orders are summed first, so a task sees the rows of one block, or one row for each block of
    a group. ``sums`` is read twice, so store it if it is dear.
    """
    blocks = sums.withColumn("__block", F.floor(F.col(order) / F.lit(block)).cast("long"))
    over = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.groupBy(*group, "__block").agg(F.sum(value).alias("__whole"))
    heads = heads.select(*group, "__block", F.coalesce(F.sum("__whole").over(over), F.lit(0)).alias("__head"))
    rows = null_safe_join(blocks, heads, [*group, "__block"])
    inside = Window.partitionBy(*group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.col("__head") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__block", "__head")


def sliced_running_sum(
    df: DataFrame, group: list[str], position: str, ties: list[str], value: str, into: str,
    rows_per_slice: int = ROWS_PER_SLICE, spread: str | None = None,
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the group that come before this one.

    ``position`` is a 60-bit hash column; rows are ordered by it and then by ``ties``. Each group is cut
    into slices of equal hash ranges, as many as its row count asks for. Slices are summed first, their
    prefix is attached, and only rows of one slice are ever sorted together, so a group with a third of
    all rows is spread over many tasks. ``spread`` names a column that differs in every row; if given, the rows of a
    position that more than ``rows_per_slice`` rows of a group share (one id, or null) are cut by its hash too and
    come last in their slice. Every value is an exact function of the rows: a lost executor's
    work is redone with the same result. ``df`` is read twice, so store it first if it is dear.
    """
    n = F.count(F.lit(1))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / F.lit(float(rows_per_slice))))).cast("int")
    sizes = df.groupBy(*group).agg(n.alias("__n")).select(*group, F.least(bits, F.lit(40)).alias("__bits"))
    rows = with_lookup(df, sizes, group).withColumn(
        "__slice", F.when(F.col("__bits") > 0, F.expr(f"shiftright({position}, 60 - __bits)")).otherwise(F.lit(0).cast("long"))
    ).drop("__bits")
    sums = stored(rows.groupBy(*group, "__slice").agg(F.sum(value).alias("__sum"), n.alias("__n")), "slices")
    starts = prefix_sums(sums.drop("__n"), group, "__slice", "__sum", "__start").drop("__sum")
    keys = ["__slice"]
    heavy = sums.where(F.col("__n") > 4 * rows_per_slice).select(*group, "__slice")
    if spread is not None and not heavy.isEmpty():
        crowded = with_lookup(rows, heavy, [*group, "__slice"], "inner").groupBy(*group, position).agg(n.alias("__same"))
        rows = with_lookup(rows, crowded.where(F.col("__same") > rows_per_slice), [*group, position])
        part = F.pmod(F.xxhash64(spread), F.ceil(F.col("__same") / F.lit(float(rows_per_slice)))).cast("long")
        rows = rows.withColumn("__part", F.when(F.col("__same").isNull(), F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("no")))
                               .otherwise(F.struct(F.col(position).alias("at"), part.alias("no")))).drop("__same")
        keys.append("__part")
        own = Window.partitionBy(*group, "__slice").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.groupBy(*group, *keys).agg(F.sum(value).alias("__sum"))
        parts = null_safe_join(parts.withColumn("__in", F.coalesce(F.sum("__sum").over(own), F.lit(0))), starts, [*group, "__slice"])
        starts = parts.select(*group, *keys, (F.col("__start") + F.col("__in")).alias("__start"))
    rows = with_lookup(rows, starts, [*group, *keys])
    inside = Window.partitionBy(*group, *keys).orderBy(position, *ties, *([spread] if spread else [])).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__start", *keys)


def ordered_running_sum(df: DataFrame, group: list[str], slices: str, order: list[str], value: str, into: str) -> DataFrame:
    """Like ``sliced_running_sum`` for rows that have an order already: ``slices`` is a long that never falls along the
    ``order`` and that a bounded number of rows share."""
    sums = stored(df.groupBy(*group, slices).agg(F.sum(value).alias("__sum")), "slices")
    rows = with_lookup(df, prefix_sums(sums, group, slices, "__sum", "__start").drop("__sum"), [*group, slices])
    inside = Window.partitionBy(*group, slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__start")


def numbered_in_order(df: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """Add ``into``: the number of rows before a row in a complete order, by a range-partitioned sort.

    The sorted rows are stored; a row's number is its place in its part file plus the rows of the files before, of which there is one
    count each. No task sees more than a partition, and equal leading values spread by the rest of the order.
    """
    rows = stored(df.orderBy(*order), "sorted")
    part = F.regexp_extract(F.col("_metadata.file_path"), r"part-([0-9]+)[^/]*$", 1).cast("long")
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], part.alias("__part"), F.col("_metadata.row_index").alias("__at"))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return with_lookup(rows, starts, ["__part"]).withColumn(into, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")

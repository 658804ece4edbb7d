"""Packing documents into token-budget batches inside optimal length buckets.

A dynamic programme over the histogram of all lengths chooses the bucket boundaries that need the
least padding; batches of one bucket then hold as many documents as the token budget allows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.rows import keyed
from sceneloom.llm.words import n_words
from sceneloom.numbering import hash60, ordered_running_sum, sliced_running_sum
from sceneloom.shared import stored, with_lookup

#: Rows of one file that a slice of its order holds.
ROWS_PER_SLICE = 2_000


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of the ascending ``lengths`` with the least total padding.

    A run is padded to its longest length. The cost of a run that ends at length i and starts after j is a line in i's
    length with slope minus the documents up to j, so each step of the dynamic programme walks along the lower hull of
    these lines: time and memory are in proportion to lengths times buckets, and whole numbers keep it exact.
    """
    m = len(lengths)
    if m == 0:
        return []
    n, s = [0, *accumulate(counts)], [0, *accumulate(c * x for c, x in zip(counts, lengths))]
    k = min(buckets, m)
    cost: list[int] = []  # cost[j - first] of the best runs up to length j, where j >= first
    back: list[np.ndarray] = []
    for step in range(1, k + 1):
        new, best = [], np.zeros(m + 1, dtype=np.int32)
        hull: list[tuple[int, int, int]] = []  # (documents, height, j) of lines: height - documents * length
        at = 0
        for i in range(step, m + 1):
            j = i - 1
            if step > 1 or j == 0:
                line = (n[j], (cost[j - step + 1] if step > 1 else 0) + s[j], j)
                while len(hull) - at > 1 and (line[1] - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (line[0] - hull[-2][0]):
                    hull.pop()
                hull.append(line)
            x = lengths[i - 1]
            while at + 1 < len(hull) and hull[at + 1][1] - hull[at + 1][0] * x < hull[at][1] - hull[at][0] * x:
                at += 1
            new.append(x * n[i] - s[i] + hull[at][1] - hull[at][0] * x)
            best[i] = hull[at][2]
        cost = new
        back.append(best)
    out, i = [], m
    for best in reversed(back):
        out.append(lengths[i - 1])
        i = int(best[i])
    return out[::-1]


def _widths(rows: DataFrame, buckets: int, token_budget: int) -> DataFrame:
    """Add ``bucket, boundary`` and ``__per``, the documents of a batch, to rows with ``n_words``."""
    cells = rows.groupBy("n_words").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("n_words")
    bounds = best_boundaries(cells["n_words"].tolist(), cells["n"].tolist(), buckets)
    table = rows.sparkSession.createDataFrame(
        [(i, b, max(1, token_budget // max(b, 1))) for i, b in enumerate(bounds)], "bucket int, boundary long, __per long"
    )
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    rows = rows.withColumn("bucket", F.aggregate(limits, F.lit(0), lambda a, b: a + F.when(b < F.col("n_words"), 1).otherwise(0)))
    return rows.join(F.broadcast(table), "bucket")  # at most one row for each bucket


def pack(docs: DataFrame, *, buckets: int = 16, token_budget: int = 16_384, id_col: str = "doc_id",
         text_col: str = "text", length: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, bucket, boundary, padding, batch_id, slot``.

    Lengths are words unless another ``length`` column is given. ``boundary`` is the bucket's padded
    length, ``batch_id`` is ``bucket:number`` and ``slot`` the place in the batch. A batch of bucket b
    holds ``max(1, token_budget div boundary)`` documents in hash order of their ids; only the last
    batch of a bucket may hold fewer. A document longer than the budget is a batch of its own.

    The driver sees the histogram only. Distinct lengths are at most the longest length, and their square is at most twice
    the number of all words. Null text has length 0, and a bucket of its own if that saves padding; null ids hash like the empty string and
    equal ids are ordered by length, each row a document of its own; an empty table gives an empty result; other columns are not read.
    """
    size = n_words(F.col(text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("n_words"), F.monotonically_increasing_id().alias("__row"), F.lit(1).cast("long").alias("__one"))
    rows = _widths(stored(rows, "lengths"), buckets, token_budget).withColumn("__h", hash60(F.col("doc_id")))
    rows = sliced_running_sum(rows, ["bucket"], "__h", ["doc_id", "n_words"], "__one", "__nth", spread="__row")
    return rows.select(
        "doc_id", "n_words", "bucket", "boundary", (F.col("boundary") - F.col("n_words")).alias("padding"),
        F.concat_ws(":", F.col("bucket").cast("string"), F.floor(F.col("__nth") / F.col("__per")).cast("string")).alias("batch_id"),
        (F.col("__nth") % F.col("__per")).alias("slot"),
    )


def pack_in_order(docs: DataFrame, *, buckets: int = 16, token_budget: int = 16_384, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Like ``pack``, in the order of the rows: ``doc_id, n_words, bucket, boundary, padding, reading, batch_id, slot, place``.

    ``place`` rises along the part files that ``docs`` is read from (a table that is not is stored first, and its order is that of its
    partitions). ``reading`` says whether a row is the first, second, … with its id and text. Batches, named
    ``bucket:reading:number``, hold one reading only, so no document is twice in a batch; along the batches of a bucket and
    reading, and along their slots, places rise. Nulls, repeats and empty tables go as in ``pack``.
    """
    text = F.col(f"doc.`{text_col}`")
    part = F.regexp_extract("row.file", r"part-([0-9]+)[^/]*$", 1).try_cast("long")
    rows = keyed(docs).select(
        F.col(f"doc.`{id_col}`").alias("doc_id"), n_words(text).alias("n_words"), F.xxhash64(text).alias("__text"), F.coalesce(part, F.lit(0).cast("long")).alias("__part"),
        F.col("row.file").alias("__file"), F.col("row.at").alias("__row"), F.lit(1).cast("long").alias("__one"),
    )
    rows = stored(rows, "lengths")
    files = rows.groupBy("__part", "__file").agg(F.max("__row").alias("__last"))
    files = files.withColumn("__rows", (F.floor(F.col("__last") / ROWS_PER_SLICE) + 1) * ROWS_PER_SLICE)
    # Places are the rows before a file's first, rounded up to whole slices, plus the row: one row for each file here.
    before = Window.orderBy("__part", "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__part", "__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    rows = with_lookup(rows, files, ["__part", "__file"]).withColumn("place", F.col("__start") + F.col("__row"))
    same = Window.partitionBy("doc_id", "__text", "n_words").orderBy("place")
    rows = rows.select("doc_id", "n_words", "place", "__one", F.row_number().over(same).cast("int").alias("reading"))
    rows = _widths(stored(rows, "places"), buckets, token_budget).withColumn("__slice", F.floor(F.col("place") / ROWS_PER_SLICE).cast("long"))
    rows = ordered_running_sum(rows, ["bucket", "reading"], "__slice", ["place"], "__one", "__nth")
    return rows.select(
        "doc_id", "n_words", "bucket", "boundary", (F.col("boundary") - F.col("n_words")).alias("padding"), "reading",
        F.concat_ws(":", F.col("bucket").cast("string"), F.col("reading").cast("string"), F.floor(F.col("__nth") / F.col("__per")).cast("string")).alias("batch_id"),
        (F.col("__nth") % F.col("__per")).alias("slot"), "place",
    )

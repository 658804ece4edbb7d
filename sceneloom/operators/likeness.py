"""How alike renderings and frames are, against yardsticks that are medians over all unrelated pairs (R14).

The pairs are never listed: tiles of both sides are multiplied and leave a histogram, the histograms of a clip are added, and a
second pass counts the values of the cells that hold the middle ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sceneloom.operators.retrieval import dot, normalised
from sceneloom.shared import stored, with_lookup

#: Cells of the histogram of cosines between -1 and 1.
CELLS = 65_536
#: Vectors of each side that a task holds at once.
TILE = 4_096


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors of a column of lists of the same length."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _cell(values: np.ndarray) -> np.ndarray:
    """Cells of cosines; what is no number counts as the largest."""
    return np.nan_to_num(np.clip(np.floor((values + 1) * (CELLS / 2)), 0, CELLS - 1), nan=CELLS - 1).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """The first row of each tile and its matrices, from rows sorted by ``clip, a_tile, b_tile, side``; one tile is held at a time."""
    now, head, sides = None, {}, ([], [])
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("clip", "a_tile", "b_tile"))))
        side, vec = batch.column("side").to_pylist(), batch.column("vec")
        cuts = [i for i in range(batch.num_rows) if i == 0 or keys[i] != keys[i - 1] or side[i] != side[i - 1]]
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows]):
            if keys[i] != now:
                if now is not None:
                    yield head, *(np.concatenate(x) if x else np.empty((0, 0)) for x in sides)
                now, head, sides = keys[i], batch.slice(i, 1).drop_columns("vec").to_pylist()[0], ([], [])
            sides[side[i]].append(_matrix(vec.slice(i, j - i)))
    if now is not None:
        yield head, *(np.concatenate(x) if x else np.empty((0, 0)) for x in sides)


def _per_tile(rows: DataFrame, leave: Callable[[dict, Iterator[np.ndarray]], tuple[np.ndarray, np.ndarray]], block: int, value: str) -> DataFrame:
    """``clip, value, n`` of what ``leave(head, cosines of each strip)`` keeps of every tile."""
    kind = rows.schema["clip"].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(f"clip {kind}, {value}, n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, a, b in _tiles(batches):
            if len(a) and len(b):
                values, n = leave(head, ((a[i : i + block] @ b.T).ravel() for i in range(0, len(a), block)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([head["clip"]] * len(n), values, n), arrow.types)], schema=arrow)

    keys = ["clip", "a_tile", "b_tile"]
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)  # little data for much work: not to be put together
    return dealt.sortWithinPartitions(*keys, "side", "place", "vec").drop("place").mapInArrow(run, f"clip {kind}, {value}, n long")


def _histogram(_: dict, strips: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = sum((np.bincount(_cell(values), minlength=CELLS) for values in strips), np.zeros(CELLS, dtype=np.int64))
    return np.flatnonzero(n), n[n > 0]


def _refined(head: dict, strips: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of a tile's products in the two cells asked for, each with its count."""
    kept = []
    for values in strips:
        cells = _cell(values)
        kept.append(np.unique(values[(cells == head["low_cell"]) | (cells == head["high_cell"])], return_counts=True))
    values, at = np.unique(np.concatenate([v for v, _ in kept]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in kept]), len(values)).astype(np.int64)


def cross_median(a: DataFrame, b: DataFrame, block: int = 1024, tile: int = TILE) -> DataFrame:
    """``clip, median, pairs``: the exact median cosine over all pairs of a vector of ``a`` and one of ``b`` of the same clip.

    ``a(clip, place, vec)``, ``b(clip, place, vec)``. The mean of the two middle values where their number is even. Clips that lack a
    side, and rows without a vector, have no pairs. Both sides are cut into tiles of about ``tile`` vectors by a hash; a vector goes to
    every tile of the other side, as a row of its own, and a task multiplies ``block`` vectors at a time with one tile. What leaves a pair of tiles is at most
    a row per cell; of the values, only those of the two middle cells leave, equal ones as one row.
    """
    a, b = (x.where("vec IS NOT NULL AND clip IS NOT NULL") for x in (a, b))
    tiles = lambda x, side: x.groupBy("clip").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).alias(f"{side}_tiles"))
    n = stored(tiles(a, "a").join(tiles(b, "b"), "clip"), "tiles")
    own_tile, every = (lambda s: F.pmod(F.xxhash64("place", "vec"), F.col(f"{s}_tiles"))), (lambda s: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{s}_tiles") - 1)))
    sides = [with_lookup(x, n, ["clip"], "inner").select("clip", "place", "vec", own_tile(s).alias(f"{s}_tile"), F.lit(k).alias("side"), f"{o}_tiles") for k, (x, s, o) in enumerate(((a, "a", "b"), (b, "b", "a")))]
    sides = [stored(x, "vectors") for x in sides]
    spread = lambda: sides[0].select("clip", "side", "place", "vec", "a_tile", every("b").alias("b_tile")).unionByName(sides[1].select("clip", "side", "place", "vec", every("a").alias("a_tile"), "b_tile"))
    cells = _per_tile(spread(), _histogram, block, "cell long").groupBy("clip", "cell").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("clip")
    upto = stored(cells, "cells").withColumn("upto", F.sum("n").over(own.orderBy("cell"))).withColumn("pairs", F.sum("n").over(own))
    low, high = F.expr("(pairs + 1) div 2"), F.expr("pairs div 2 + 1")
    start = F.col("upto") - F.col("n")
    middle = upto.groupBy("clip").agg(
        F.max("pairs").alias("pairs"), F.min(F.when(F.col("upto") >= low, F.col("cell"))).alias("low_cell"), F.min(F.when(F.col("upto") >= high, F.col("cell"))).alias("high_cell"),
        F.min(F.when(F.col("upto") >= low, start)).alias("before"),
    )
    middle = stored(middle, "middle")
    values = _per_tile(with_lookup(spread(), middle.select("clip", "low_cell", "high_cell"), ["clip"]), _refined, block, "value double").groupBy("clip", "value").agg(F.sum("n").alias("n"))
    ranked = with_lookup(values, middle, ["clip"]).withColumn("upto", F.col("before") + F.sum("n").over(own.orderBy("value")))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    return ranked.groupBy("clip").agg(((at(low) + at(high)) / 2).alias("median"), F.max("pairs").alias("pairs"))


def likeness_report(frames: DataFrame, unrelated: DataFrame | None = None, other_renders: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """Likeness of each clip's renderings with its frames, and where it lies between its yardsticks.

    ``frames(clip, place, vec, render)``: a frame's vector and that of the rendering paired with it (null: not compared).
    ``unrelated(clip, place, vec)`` are frames of another video, ``other_renders`` renderings of another clip's scene. Returns ``clip, n, median,
    mean, least, most, reference_self`` (adjacent frames), ``reference_unrelated``, ``reference_other_render``, ``normalised`` (0 at the floor, 1 at
    the adjacent frames; null where they do not differ) and ``normalised_against``; renderings are the floor where there are any.
    """
    order = Window.partitionBy("clip").orderBy("place", "vec")
    rows = frames.where("vec IS NOT NULL").withColumns({"__v": normalised(F.col("vec")), "__r": F.when(F.col("render").isNotNull(), normalised(F.col("render")))})
    rows = rows.withColumn("__next", F.lead("__v").over(order)).select("clip", dot(F.col("__v"), F.col("__r")).alias("s"), dot(F.col("__v"), F.col("__next")).alias("own"))
    half = F.lit(0.5)
    out = rows.groupBy("clip").agg(F.count("s").alias("n"), F.percentile("s", half).alias("median"), F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"),
                                   F.percentile("own", half).alias("reference_self")).where("n > 0")
    for name, other in (("unrelated", unrelated), ("other_render", other_renders)):
        if other is None:
            out = out.withColumn(f"reference_{name}", F.lit(None).cast("double"))
        else:
            floor = cross_median(frames.select("clip", "place", "vec"), other, block)
            out = with_lookup(out, floor.select("clip", F.col("median").alias(f"reference_{name}")), ["clip"])
    floor = F.coalesce("reference_other_render", "reference_unrelated")
    span = F.col("reference_self") - floor
    out = out.withColumn("normalised", F.when(span > 1e-6, (F.col("median") - floor) / span))
    against = F.when(F.col("reference_other_render").isNotNull(), F.lit("other_render")).otherwise(F.lit("unrelated_video"))
    return out.withColumn("normalised_against", F.when(F.col("normalised").isNotNull(), against))

"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (of all values as text) up to which a side that was counted is broadcast; beyond either the join is
#: left to the optimiser.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000

_own_root: str | None = None
#: Paths of the tables stored inside each open ``scratch`` block.
_open_blocks: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local session that has none."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="sceneloom-")
    return f"file://{_own_root}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame this survives lost executors, and later plans see
    a plain scan that can be pruned.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if _open_blocks:
        _open_blocks[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read again; other frames are left alone."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables stored inside the block at its end, except those passed to the function it gives."""
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stored_at)
        return df

    _open_blocks.append(paths)
    try:
        yield keep
    finally:
        _open_blocks.remove(paths)
        for path in paths:
            if path not in kept:
                _delete(spark, path)
        if _open_blocks:
            _open_blocks[-1].extend(kept)


def is_small(lookup: DataFrame) -> bool:
    """Whether a table has few enough rows and bytes to be sent to every executor."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in lookup.columns), F.lit(0)).cast("long")
    rows, size = lookup.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def with_lookup(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a lookup table; broadcast it only if a count of its rows and bytes shows that it is small.

    A lookup that is not stored yet is stored first, as it is read for the count and for the join. Otherwise both sides
    are shuffled by the key and adaptive execution splits hot keys. Keys match null-safely, so a null group finds its row.
    """
    if getattr(lookup, "_stored_at", None) is None:
        lookup = stored(lookup, "lookup")
    return null_safe_join(df, lookup, on, how, small=is_small(lookup))


def null_safe_join(df: DataFrame, other: DataFrame, on: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join by columns of the same name, null matching null; ``small`` says that ``other`` may be broadcast."""
    right = other.select([F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in other.columns])
    cond = None
    for c in on:
        one = df[c].eqNullSafe(right[f"__on_{c}"])
        cond = one if cond is None else cond & one
    joined = df.join(F.broadcast(right) if small else right, cond, how)
    if how in ("left_anti", "left_semi"):
        return joined
    return joined.drop(*[f"__on_{c}" for c in on])

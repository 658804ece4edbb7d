"""Exact dedup by content-defined chunk recipes.

A text is cut where its own content says so, chunks are known by digests, and a document is the ordered
list of its chunks' verified identifiers. Texts are equal if their lists are. Documents move through
the shuffle as lists of 16-byte digests, never as texts. That a digest stands for one chunk is proved by
the chunk's length and SHA-256; where it does not, the identifiers are numbered apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.rows import keep_rows
from sceneloom.shared import stored


@dataclass(frozen=True)
class Chunking:
    """``mask_bits`` sets the mean distance of cut points (2**mask_bits bytes), ``least`` and ``most`` bound a
    chunk, ``digest_bytes`` is the length of the digest (fewer bytes make collisions, for tests)."""

    mask_bits: int = 12
    least: int = 512
    most: int = 32_768
    digest_bytes: int = 16


def cut_points(data: bytes, c: Chunking) -> list[int]:
    """Ends of the chunks of ``data``. A cut depends on the 8 bytes before it, and on the bounds."""
    n = len(data)
    if n <= c.least:
        return [n] if n else []
    raw = np.frombuffer(data, dtype=np.uint8)
    hot = np.empty(0, dtype=np.int64)
    if n >= 8:
        # Eight-byte windows at every offset, hashed by one multiplication.
        windows = np.lib.stride_tricks.as_strided(raw, shape=(n - 7, 8), strides=(1, 1))
        parts = []
        for at in range(0, n - 7, 1 << 18):
            w = np.ascontiguousarray(windows[at : at + (1 << 18)]).view(np.uint64).ravel()
            mixed = (w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - c.mask_bits)
            parts.append(np.flatnonzero(mixed == 0) + (at + 8))
        hot = np.concatenate(parts)
    cuts, start = [], 0
    for p in hot.tolist():
        while p - start > c.most:
            start += c.most
            cuts.append(start)
        if p - start >= c.least:
            cuts.append(p)
            start = p
    while n - start > c.most:
        start += c.most
        cuts.append(start)
    if start < n:
        cuts.append(n)
    return cuts


def _digest(chunk: bytes, c: Chunking) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[: c.digest_bytes]


def _recipes(c: Chunking):
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, recipes = [], []
            for value in batch.column(1):
                data = (value.as_buffer().to_pybytes() if value.is_valid else b"")
                start, parts = 0, []
                for end in cut_points(data, c):
                    parts.append(_digest(data[start:end], c))
                    start = end
                recipes.append(b"".join(parts))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], schema=schema
            )

    return run


def _chunks(c: Chunking, seen_limit: int = 200_000):
    """Distinct (digest, proof) of a task, as far as its bounded memory reaches; proof is length and SHA-256."""
    schema = pa.schema([("digest", pa.binary()), ("proof", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for value in batch.column(0):
                if not value.is_valid:
                    continue
                for key, proof in _proved(value.as_buffer().to_pybytes(), c):
                    if key + proof in seen:
                        continue
                    if len(seen) < seen_limit:
                        seen.add(key + proof)
                    out.append((key, proof))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], schema=schema)

    return run


def _proved(data: bytes, c: Chunking) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in cut_points(data, c):
        chunk = data[start:end]
        start = end
        yield _digest(chunk, c), len(chunk).to_bytes(4, "big") + hashlib.sha256(chunk).digest()


def _numbered(c: Chunking):
    """Every chunk of a document: (doc_key, at, digest, proof)."""
    schema = pa.schema([("doc_key", pa.string()), ("at", pa.int32()), ("digest", pa.binary()), ("proof", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                if not value.is_valid:
                    continue
                data = value.as_buffer().to_pybytes()
                sha = hashlib.sha256(data).hexdigest()
                rows += [(sha, at, key, proof) for at, (key, proof) in enumerate(_proved(data, c))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.types[i]) for i in range(4)], schema=schema)

    return run


def collided_chunks(docs: DataFrame, c: Chunking, text_col: str = "text") -> DataFrame:
    """Chunks that share a digest with a different chunk, numbered: ``(digest, proof, nth)``.

    With 16-byte digests the result is empty unless chunks were made to collide. Digests are compared before
    the shuffle as far as a task sees them, so a chunk that all documents share is a row per task.
    """
    distinct = docs.select(text_col).mapInArrow(_chunks(c), "digest binary, proof binary")
    clashes = stored(distinct.groupBy("digest").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).where("a <> b").select("digest"), "clashes")
    if clashes.isEmpty():
        return docs.sparkSession.createDataFrame([], "digest binary, proof binary, nth int")
    again = distinct.join(clashes, "digest", "left_semi").distinct()
    return stored(again.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("proof"))), "verified")


def recipes(docs: DataFrame, chunking: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, recipe``: the ordered list of verified chunk identifiers, packed into bytes."""
    c = chunking
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = stored(base.mapInArrow(_recipes(c), "doc_id long, text_sha256 string, recipe binary"), "recipes")
    clashes = collided_chunks(docs, c, text_col)
    if clashes.isEmpty():
        return out
    # Lists with a collided digest get the number of the chunk behind each identifier.
    numbered = docs.select(text_col).mapInArrow(_numbered(c), "doc_key string, at int, digest binary, proof binary")
    marks = numbered.join(clashes, ["digest", "proof"]).groupBy("doc_key").agg(F.array_sort(F.collect_set(F.struct("at", "nth"))).alias("marks"))
    marks = marks.select("doc_key", F.to_json("marks").cast("binary").alias("marks"))
    return out.join(marks, F.col("text_sha256") == F.col("doc_key"), "left").select(
        "doc_id", "text_sha256", F.concat("recipe", F.coalesce("marks", F.lit(b""))).alias("recipe")
    )


def exact_groups(docs: DataFrame, chunking: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id is kept. Null text counts as empty, and all empty texts
    are one group. A null id never wins over another id; a group of null ids alone has a null ``keep_id``
    and all its rows are kept, as they cannot be told apart. Repeated rows (equal id and text) each count
    and share their ``kept`` flag. An empty table gives an empty result; other columns are not read.

    Groups are counted before the shuffle, so a text held by a third of all rows is one row per task.
    """
    rows = recipes(docs, chunking, id_col, text_col)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = rows.join(stored(groups, "groups"), "recipe")  # stored, so that a hot list's rows can be split
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns. Rows are told apart by id and text: a repeated id with another
    text stays, rows that repeat both stay as one row, and of texts with null ids alone one row stays."""
    return keep_rows(docs, groups, id_col, text_col)

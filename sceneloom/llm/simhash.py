"""SimHash near-dedup with Golay-code fuzzy keys.

The 64-bit fingerprint is split into three segments. Two fingerprints that differ in at most two bits have a
segment without an error, and the next segment (cyclically) then holds at most two; the pairing
below meets every pattern of errors with one segment exact and the next off by at most one bit.
The second segment is decoded by the perfect (23, 12) Golay code: the codeword indices of a segment and
of its one-bit neighbours are a few keys only, and segments one bit apart share one. Candidates are
joined by (exact segment, codeword index) and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.components import connected_components
from sceneloom.llm import near_sets
from sceneloom.llm.rows import keep_rows
from sceneloom.llm.shingles import SEED, SHINGLE, fingerprint, shingle_hashes
from sceneloom.shared import stored

MAX_BITS = 2
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101
#: A key whose pairs would exceed this goes the other way, which needs 65 rows a fingerprint.
PAIRS_PER_KEY = 4_096


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(shingle_hashes(v.as_buffer().to_pybytes())) if v.is_valid else 0 for v in batch.column(1)]
        prints = np.array(values, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = values.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - 11), 0)
    return rest


def _error_table() -> np.ndarray:
    """The error of at most three bits behind each of the 2,048 syndromes; the code is perfect."""
    errors = [0] + [sum(1 << b for b in bits) for w in (1, 2, 3) for bits in combinations(range(23), w)]
    errors = np.array(errors, dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_syndromes(errors)] = errors
    return table


ERRORS = _error_table()


def codeword_index(values: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (values ^ ERRORS[_syndromes(values)]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own) of fingerprints given as uint64: at most six keys for each of three pairs of segments.

    ``own`` marks the index of the segment itself. If two fingerprints link, one's own key is among the
    other's keys.
    """
    rows, keys, own = [], [], []
    segments = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for pair in range(3):
        exact, loose, width = segments[pair], segments[(pair + 1) % 3], SEGMENTS[(pair + 1) % 3][1]
        flips = np.array([0] + [1 << b for b in range(width)], dtype=np.int64)
        index = codeword_index(loose[:, None] ^ flips[None, :])
        mine = index[:, 0]
        index = np.sort(index, axis=1)
        first = np.ones(index.shape, dtype=bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        r, c = np.nonzero(first)
        idx = index[r, c]
        rows.append(r)
        keys.append((np.int64(pair) << 34) | (exact[r] << 12) | idx)
        own.append(idx == mine[r])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        prints = np.asarray(batch.column(0)).astype(np.int64)
        r, keys, own = golay_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(prints[r]), pa.array(keys), pa.array(own)], names=["fp", "key", "own"])


def links(prints: DataFrame, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Links between the distinct fingerprints of ``prints(fp)`` that connect all within two bits.

    Keys of moderate size are joined and each candidate is verified. Where a key holds so many
    fingerprints that pairs would grow with their square, each of them is sent to itself and its 64 one-bit
    neighbours instead: two within two bits meet at a midpoint, and any two that meet there are within
    two bits, so a star replaces the pairs. No candidate is dropped either way.
    """
    keyed = prints.mapInArrow(_keyed, "fp long, key long, own boolean")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("long")).alias("k")).where("n > 1 and k > 0")
    live = stored(keyed.join(sizes, "key"), "keys")
    light = live.where(F.col("n") * F.col("k") <= pairs_per_key)
    left = light.where("own").select("key", F.col("fp").alias("a"))
    right = light.select("key", F.col("fp").alias("b"))
    near = left.join(right, "key").where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    crowded = live.where(F.col("n") * F.col("k") > pairs_per_key).select("fp").distinct()
    spots = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = crowded.select("fp", F.explode(spots).alias("spot"))
    star = met.withColumn("b", F.min("fp").over(Window.partitionBy("spot")))  # at most 65 fingerprints to a spot
    return near.union(star.where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id that links of at most two
    differing bits reach, itself included. Null or wordless text has fingerprint zero and is linked like
    any other. A null id gets a fingerprint and the component of the others, null if it has no others.
    Repeated rows are each returned. An empty table gives an empty result; other columns are not read.

    Documents are first reduced to distinct fingerprints with their least id, so copies never meet in pairs.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(base.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(links(distinct.select("fp"), pairs_per_key))
    linked = distinct.join(labels, distinct["fp"] == labels["node"])
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "component").select("fp", "component_id")
    known = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(stored(known, "components"), "fp").select(  # stored, so that a hot fingerprint's rows can be split
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_sha256, kept``; of each group of near copies the row with the least id stays.

    Near copies are texts whose sets of ``shingle``-word shingles have a Jaccard similarity of at least ``similarity``, and groups
    are connected by such pairs. Fingerprints within two bits propose pairs first, through their Golay keys, and
    exact shared parts of the sets (``near_sets``) propose those that fingerprints miss; every pair is verified on the sets, and no pair
    that is similar enough is missed. Wordless and null texts are one group. A null id comes after all others, equal ids are
    ordered by the digests of their texts; rows that repeat id and text share their ``kept``. An empty table gives an empty result; other
    columns are not read.
    """
    nodes, keys = near_sets.shingled(docs, similarity, shingle, id_col, text_col)
    first = nodes.where("row = first")
    prints = stored(first.groupBy("fp").agg(F.min("row").alias("least")), "distinct")
    near = links(prints.select("fp"))
    ends = [prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_row")) for c in "ab"]
    proposed = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_row").alias("a"), F.col("b_row").alias("b"))
    same = first.join(prints, "fp").where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    labels = near_sets.similar(docs, nodes, keys, proposed.union(same), similarity, shingle, id_col, text_col)
    rows = nodes.join(labels, nodes["first"] == labels["node"], "left").select(
        "doc_id", "text_sha256", F.coalesce("component", "first").alias("group"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha256").alias("own")
    )
    rows = stored(rows, "grouped")
    best = rows.groupBy("group").agg(F.min("own").alias("best"))
    return rows.join(stored(best, "kept"), "group").select("doc_id", "text_sha256", (F.col("own") == F.col("best")).alias("kept"))


def keep_one(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``near_copies`` keeps, with their own columns; rows that repeat id and text stay as one row."""
    return keep_rows(docs, copies, id_col, text_col)

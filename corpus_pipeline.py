"""The corpus pipeline: from raw documents to packed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents with their own
columns. Between stages the driver (or ``run``) writes the result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sceneloom.llm import exact_dedup, mixing, packing, quality, simhash
from sceneloom.shared import release, scratch, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive fences."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact_dedup.drop_copies(docs, exact_dedup.exact_groups(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more), the one with the smallest id."""
    return simhash.keep_one(docs, simhash.near_copies(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, as often as their source's target asks for (none, once or twice)."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document reading with its bucket, batch and slot, in training order."""
    return packing.pack_in_order(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("source mixing", source_mix),
    ("packing", packed),
]

#: XXH64 fingerprints and their components are beyond DuckDB's SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stored for itself is deleted when its result is stored, and so is its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(stored(stage(spark, before, sf_dir), name.replace(" ", "-")))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)

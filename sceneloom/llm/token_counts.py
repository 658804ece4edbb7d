"""Token counts with a digest cache.

Documents are known by the SHA-256 of their content and of the tokenizer's file. Counts that the cache
holds are joined; each distinct miss is encoded once and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.shared import shared_path, stored, with_lookup

CACHE = "digest binary, version string, n_tokens long"
#: Texts go to the tokenizer in groups of at most so many bytes, which bounds a worker's memory.
BYTES_AT_ONCE = 1_000_000
#: Digests that a task remembers to drop copies before the shuffle; beyond them copies meet after it.
SEEN = 200_000


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column) -> Column:
    """What is encoded and digested: null becomes empty; else the text as it is, since this tokenizer sees all of it."""
    return F.coalesce(text, F.lit(""))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop rows whose digest this task has sent already, as far as its bounded memory reaches."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                if len(seen) < SEEN:
                    seen.add(d)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _encoder(path: str):
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        seen: set[bytes] = set()
        for batch in batches:
            digests, counts, texts, held = [], [], [], 0

            def encode() -> None:
                counts.extend(len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
                texts.clear()

            for d, t in zip(batch.column(0), batch.column(1)):
                key = d.as_py()
                if key in seen:
                    continue
                seen.add(key)
                digests.append(key)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held > BYTES_AT_ONCE:
                    encode()
                    held = 0
            encode()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], schema=schema)

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's counts; an empty table if nothing was written yet. A digest written twice counts once."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a tokenizers JSON file that all machines have; ``cache`` a Parquet folder
    that grows (a fresh one in the shared folder if not given). Texts are encoded whole, without added special
    tokens, truncation or padding. Null text counts as empty; null and repeated ids are each returned; an empty table
    gives an empty result and appends nothing; other columns are not read.

    Digests are joined to the cache first, so the texts of hits are dropped where they are read, unless there are too many
    misses to send their digests to all tasks. Copies of misses are dropped per task before texts are dealt by digest, so a text held by
    a third of all rows moves once a task and is encoded once. Very long texts are encoded whole, one at a time.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache = cache or shared_path(spark, "token-cache")
    text = normalised(F.col(text_col))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _digest(text).alias("digest")), "digests")
    known = read_cache(spark, cache).where(F.col("version") == version)
    texts = docs.select(_digest(text).alias("digest"), text.alias("text"))
    if not known.isEmpty():
        misses = rows.select("digest").distinct().join(known.select("digest"), "digest", "left_anti")
        texts = with_lookup(texts, stored(misses, "misses"), ["digest"], "left_semi")
    texts = texts.mapInArrow(_first_of_task, "digest binary, text string").repartition("digest")
    fresh = texts.mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = stored(read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens"), "counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

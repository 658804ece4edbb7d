"""Queries of this package over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm import divergence, exact_dedup, html_extract, language, merkle, mixing, oracles, packing, pii, quality, secret_scan, simhash, token_counts, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_read(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_read(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the row of ``labels`` with their number: bad if toxic or of low quality."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), labels)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh cache for each call, so that no run profits from an earlier one."""
    import public_tokenizers

    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.tampered_leaves(_read(spark, sf_dir, "documents")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(_read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_mix_sources, op2_simhash_near_dedup, op3_packing, op4_secret_scan, op5_pii, op6_url_filter, op7_exact_dedup, op8_quality_rules,
        op9_html_extract, op10_token_counts, op11_merkle_manifest, op12_language_id, op13_source_divergence,
    ]
    return {f.__name__: f for f in own}


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _position_sql(c: mixing.Curriculum) -> str:
    """The inverse of each integrated schedule at q, as a CASE over slots and pieces."""
    slots = []
    for s in range(len(c.weights)):
        knots = c.schedules[s % len(c.schedules)]
        pieces = list(zip(knots, knots[1:]))
        parts = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
        whole = done = sum(parts)
        sql = ""
        for ((t0, w0), (t1, w1)), part in reversed(list(zip(pieces, parts))):
            end, done = done, done - part
            r = f"(greatest(q * {whole!r}::DOUBLE - {done!r}::DOUBLE, 0::DOUBLE) / {t1 - t0!r}::DOUBLE)"
            root = f"sqrt(greatest({w0 * w0!r}::DOUBLE + {2.0 * (w1 - w0)!r}::DOUBLE * {r}, 0::DOUBLE))"
            u = f"(CASE WHEN {r} > 0 THEN 2::DOUBLE * {r} / ({w0!r}::DOUBLE + {root}) ELSE 0 END)"
            here = f"({t0!r}::DOUBLE + least({u}, 1::DOUBLE) * {t1 - t0!r}::DOUBLE)"
            sql = here if not sql else f"(CASE WHEN q * {whole!r}::DOUBLE < {end!r}::DOUBLE THEN {here} ELSE {sql} END)"
        slots.append(f"WHEN {s} THEN {sql}")
    return f"CASE slot {' '.join(slots)} END"


OP1 = f"""
WITH sizes AS (SELECT doc_id, source, {WORDS}::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS slot FROM per),
weighted AS (SELECT *, [5.0, 2.0, 1.0][slot + 1]::DOUBLE AS w, 2::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
stop AS (SELECT level AS last_level FROM levels WHERE NOT cap / w <= level ORDER BY caps, level LIMIT 1),
targets AS (
  SELECT source, source_size, slot,
         CASE WHEN cap / w <= level OR (SELECT last_level FROM stop) IS NULL THEN cap ELSE w * (SELECT last_level FROM stop) END AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, slot, target, floor(target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes JOIN targets USING (source)),
taken AS (
  SELECT *, greatest(least(budget - before, size), 0) AS take0, greatest(least(budget - before - source_size, size), 0) AS take1 FROM placed),
first AS (
  SELECT *, least(CASE WHEN take0 > 0 THEN before::DOUBLE + take0 / 2::DOUBLE
                  ELSE (before + source_size)::DOUBLE + take1 / 2::DOUBLE END / budget, 1::DOUBLE) AS q FROM taken)
SELECT doc_id, size, source_size, target, (take0 + take1)::BIGINT AS taken,
       CASE WHEN take0 + take1 > 0 THEN round({_position_sql(mixing.Curriculum())}, 6) END AS position
FROM first
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

METRICS = {"symbols": "(n_symbols * 1000) // greatest(n_words, 1)", "dup_lines": "(n_dup_lines * 1000) // greatest(n_lines, 1)",
           "repeats": "(n_repeat_words * 1000) // greatest(n_words, 1)", "word_chars": "(word_chars * 100) // greatest(n_words, 1)"}


def _op8_sql(f: quality.Fences) -> str:
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    cell = f"greatest(length(bin(v)) - {quality.SKETCH_BITS}, 0)"
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS v FROM m WHERE n_words > 0" for k, v in METRICS.items())

    def quartiles(name: str, keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        part = f"PARTITION BY {by}"
        return f"""
{name}0 AS (SELECT {by}, cell, sum(n) AS n, max(top) AS top FROM sketch GROUP BY {by}, cell),
{name}1 AS (SELECT *, sum(n) OVER ({part} ORDER BY cell) AS upto, sum(n) OVER ({part}) AS n_all FROM {name}0),
{name} AS (SELECT {by}, max(n_all) AS n_all, min(top) FILTER (WHERE 4 * upto >= n_all) AS lo, min(top) FILTER (WHERE 4 * upto >= 3 * n_all) AS hi
           FROM {name}1 GROUP BY {by})"""

    spread = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in f.least_spread) + " END::DOUBLE"
    tests = " AND ".join(
        f"coalesce({v} <= {k}_max, true)" + (f" AND coalesce({v} >= {k}_min, true)" if k in f.two_sided else "") for k, v in METRICS.items()
    )
    ends = ", ".join(f"max(lo - reach) FILTER (WHERE metric = '{k}') AS {k}_min, max(hi + reach) FILTER (WHERE metric = '{k}') AS {k}_max" for k in METRICS)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) AS lines FROM t),
windows AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(translate(text, {spaces}, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (rid)),
v AS ({values}),
sketch AS (SELECT lang, source, metric, {cell} * {1 << (quality.SKETCH_BITS - 1)} + floor(v / 2::DOUBLE ** {cell})::BIGINT AS cell, count(*) AS n, max(v) AS top FROM v GROUP BY ALL),
{quartiles("own", "lang, source")}, {quartiles("lng", "lang")}, {quartiles("every", "")},
picked AS (
  SELECT own.lang, own.source, own.metric,
         CASE WHEN own.n_all >= {f.least_rows} THEN own.lo WHEN lng.n_all >= {f.least_rows} THEN lng.lo ELSE every.lo END::DOUBLE AS lo,
         CASE WHEN own.n_all >= {f.least_rows} THEN own.hi WHEN lng.n_all >= {f.least_rows} THEN lng.hi ELSE every.hi END::DOUBLE AS hi
  FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.metric = lng.metric JOIN every ON every.metric = own.metric),
reached AS (SELECT *, {f.reach!r}::DOUBLE * greatest(hi - lo, {spread}) AS reach FROM picked),
fences AS (SELECT lang, source, {ends} FROM reached GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {tests} AS kept
FROM m LEFT JOIN fences ON m.lang IS NOT DISTINCT FROM fences.lang AND m.source IS NOT DISTINCT FROM fences.source
"""


OP8 = _op8_sql(quality.Fences())

ORACLES: dict[str, str] = {"op8_quality_rules": OP8, "op1_mix_sources": OP1, "op7_exact_dedup": OP7} | oracles.ORACLES

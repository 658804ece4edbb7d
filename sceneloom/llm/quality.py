"""Quality rules with adaptive thresholds (native).

Fixed cutoffs are replaced by fences from quantile sketches of every language and source. A sketch is a
histogram over cells of bounded relative width: it merges by adding counts, its size is bounded, and
unlike sampled sketches it gives the same answer in every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.rows import keyed
from sceneloom.shared import stored, with_lookup

BREAK = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Cells of a sketch are exact below 2**SKETCH_BITS and 2**-(SKETCH_BITS - 1) of the value wide above.
SKETCH_BITS = 6


def length_cell(length: Column, exact_bits: int) -> Column:
    """Monotone cell number of a value; there are at most 2**exact_bits of them per power of two."""
    shift = F.greatest(F.length(F.bin(length)) - F.lit(exact_bits), F.lit(0))
    return shift.cast("long") * F.lit(1 << (exact_bits - 1)) + F.floor(length / F.pow(F.lit(2.0), shift)).cast("long")


@dataclass(frozen=True)
class Fences:
    """A value is out of bounds beyond ``reach`` spreads above the upper quartile (or below the lower one).

    ``spread`` is the interquartile range, at least ``least_spread`` (in the metric's own unit). Groups of
    fewer than ``least_rows`` rows use the sketch of their language, and that of all rows below this.
    """

    reach: float = 6.0
    least_rows: int = 50
    least_spread: tuple[tuple[str, float], ...] = (
        ("symbols", 25.0), ("dup_lines", 100.0), ("repeats", 60.0), ("word_chars", 40.0)
    )
    two_sided: tuple[str, ...] = ("word_chars",)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines``, and the columns
    named in ``carry``.

    Repeated windows are found inside the row: the hashes of all three-word windows are sorted with their
    places, equal neighbours mark repeats, and the words under marked windows are counted once each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        *carry, F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.filter(F.split(text, BREAK, -1), lambda w: w != "").alias("words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
    )
    words = F.col("words")
    hashes = F.when(
        F.size(words) >= 4,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])),
    ).otherwise(F.array().cast("array<long>"))
    second = first.select(
        *carry, "doc_id", "lang", "source", "n_symbols", "word_chars", F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    places = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.withColumn("placed", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), places)).drop("hashes")
    placed = F.col("placed")
    marked = F.filter(
        placed,
        lambda x, k: ((k > 0) & (F.get(placed, k - 1)["h"] == x["h"])) | ((k + 1 < F.size(placed)) & (F.get(placed, k + 1)["h"] == x["h"])),
    )
    starts = F.sort_array(F.transform(marked, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n")), lambda a: a["n"],
    )
    return third.select(
        *carry, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The judged metrics as whole numbers: per thousand words or lines, word length in hundredths."""
    def per(part: str, whole: str, unit: int) -> Column:
        return F.expr(f"({part} * {unit}) div greatest({whole}, 1)")

    return {
        "symbols": per("n_symbols", "n_words", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000),
        "repeats": per("n_repeat_words", "n_words", 1000), "word_chars": per("word_chars", "n_words", 100),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, metric, cell, n, top``: mergeable histograms of all rows with words."""
    values = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rates().items()])
    rows = measured.where("n_words > 0").select("lang", "source", F.explode(values).alias("m")).select("lang", "source", "m.*")
    return rows.groupBy("lang", "source", "metric", length_cell(F.col("value"), SKETCH_BITS).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )


def _quartiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Quartiles of each metric in one row per key: the top of the cell that holds the rank."""
    merged = sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    own = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("__upto", F.sum("n").over(own.orderBy("cell"))).withColumn("__all", F.sum("n").over(own))
    aggs = [F.max("__all").alias(f"{tag}_rows")]
    for metric in rates():
        for name, quarter in (("lo", 1), ("hi", 3)):
            hit = (F.col("metric") == metric) & (F.lit(4) * F.col("__upto") >= F.lit(quarter) * F.col("__all"))
            aggs.append(F.min(F.when(hit, F.col("top"))).alias(f"{tag}_{metric}_{name}"))
    return ranked.groupBy(*keys).agg(*aggs)


def thresholds(sketch: DataFrame, fences: Fences = Fences()) -> DataFrame:
    """``lang, source`` and for each metric ``<metric>_min`` and ``<metric>_max`` (doubles)."""
    own = _quartiles(sketch, ["lang", "source"], "own")
    lang = _quartiles(sketch, ["lang"], "lang")
    # One row of quartiles over everything: a few numbers, whatever the input, so the driver may hold them.
    every = _quartiles(sketch.withColumn("__key", F.lit(0)), ["__key"], "every").first()
    table = with_lookup(own, lang, ["lang"])
    spreads = dict(fences.least_spread)
    out = [F.col("lang"), F.col("source")]
    for metric in rates():
        def pick(end: str, m: str = metric) -> Column:
            return (
                F.when(F.col("own_rows") >= fences.least_rows, F.col(f"own_{m}_{end}"))
                .when(F.col("lang_rows") >= fences.least_rows, F.col(f"lang_{m}_{end}"))
                .otherwise(F.lit(every[f"every_{m}_{end}"] if every else None)).cast("double")
            )
        lo, hi = pick("lo"), pick("hi")
        reach = F.lit(fences.reach) * F.greatest(hi - lo, F.lit(spreads[metric]))
        out.append((lo - reach if metric in fences.two_sided else F.lit(None).cast("double")).alias(f"{metric}_min"))
        out.append((hi + reach).alias(f"{metric}_max"))
    return table.select(*out)


def judge(docs: DataFrame, fences: Fences = Fences(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, the measures, ``base_failed``, ``kept``.

    A document is kept if it passes the base rules and no metric lies beyond the fences of its
    language and source. Null text counts as empty (no words, fails the base). Null languages and sources
    are groups of their own. Repeated rows are judged alike, each in its row. An empty table gives an empty
    result; other columns are not read. A hot source costs nothing more: histograms are summed before the
    shuffle, and the thresholds are one row per language and source.
    """
    measured = stored(measures(docs, id_col, text_col, lang_col, source_col), "measures")
    return _judged(measured, fences).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept",
    )


def _judged(measured: DataFrame, fences: Fences) -> DataFrame:
    """Stored measures with the thresholds of their language and source, and ``kept``."""
    rows = with_lookup(measured, thresholds(stored(sketches(measured), "sketches"), fences), ["lang", "source"])
    inside = F.lit(True)
    for metric, value in rates().items():
        inside = inside & F.coalesce(value <= F.col(f"{metric}_max"), F.lit(True)) & F.coalesce(value >= F.col(f"{metric}_min"), F.lit(True))
    return rows.withColumn("kept", ~base_failed() & inside)


def keep_good(docs: DataFrame, fences: Fences = Fences(), id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns.

    Verdicts are joined back by the row's place, so null and repeated ids go by their own row; repeated rows that are good all
    stay. Null and empty texts go (no words); an empty table gives an empty result.
    """
    rows = keyed(docs)
    names = {id_col: "doc_id", text_col: "text", lang_col: "lang", source_col: "source"}
    measured = measures(rows.select("row", *[F.col(f"doc.`{c}`").alias(n) for c, n in names.items()]), carry=("row",))
    judged = _judged(stored(measured, "measured"), fences)
    return with_lookup(rows, stored(judged.where("not kept").select("row"), "rejected"), ["row"], "left_anti").select("doc.*")

"""Mixing sources to target weights along a time-varying curriculum (native).

Every source has a share weight and a weight schedule over training time. The schedule is integrated,
the cumulative token demand of a source is inverted at the tokens that come before a document, and the
document gets the training position at which the curriculum asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.rows import keyed
from sceneloom.llm.words import n_words
from sceneloom.numbering import hash60, sliced_running_sum
from sceneloom.shared import stored, with_lookup


@dataclass(frozen=True)
class Curriculum:
    """Parameters of a mix.

    ``weights`` are dealt to the sources in code-point order (a null source comes last), repeating.
    ``schedules`` are dealt likewise: knots (time, relative weight) from time 0 to 1, linear between
    them; only their shape matters, as each is normalised to the source's share. ``share`` is the size
    of the mix as a part of all words, ``max_repeat`` how often a source may be read at most.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    schedules: tuple[tuple[tuple[float, float], ...], ...] = field(
        default=(((0.0, 1.0), (0.5, 1.0), (1.0, 0.4)), ((0.0, 0.5), (1.0, 1.0)), ((0.0, 0.0), (0.6, 1.0), (1.0, 1.0)))
    )
    share: float = 1.5
    max_repeat: int = 2


def source_targets(sizes: DataFrame, c: Curriculum) -> DataFrame:
    """``(source, source_size, slot, target)`` from ``(source, size)``.

    Targets stop at ``max_repeat`` times the source's size. In order of cap per weight the sources that
    are held at their cap come first, so running sums give the level at which the excess is
    reshared by weight, in one pass. The windows see one row per source.
    """
    n = len(c.weights)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in c.weights])
    per = per.withColumn("slot", ((F.row_number().over(rank) - 1) % n).cast("int")).withColumn("__w", weights[F.col("slot")])
    per = per.withColumn("__cap", F.lit(float(c.max_repeat)) * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    per = (
        per.withColumn("__goal", F.lit(float(c.share)) * F.sum("source_size").over(everything))
        .withColumn("__caps", F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__left", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__goal") - F.col("__caps")) / F.col("__left"))
        .withColumn("__held", F.col("__cap") / F.col("__w") <= F.col("__level"))
    )
    level = F.min(F.when(~F.col("__held"), F.struct("__caps", "__level"))).over(everything)
    return per.withColumn("__at", level).select(
        "source", "source_size", "slot", "__docs",
        F.when(F.col("__held") | F.col("__at").isNull(), F.col("__cap")).otherwise(F.col("__w") * F.col("__at.__level")).alias("target"),
    )


def _position(slot: Column, q: Column, c: Curriculum) -> Column:
    """Time at which a source's integrated schedule reaches the part ``q`` of its whole."""
    out = F.lit(None).cast("double")
    for s in reversed(range(len(c.weights))):
        knots = c.schedules[s % len(c.schedules)]
        parts = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole = sum(parts)
        at, done = None, whole
        for ((t0, w0), (t1, w1)), part in reversed(list(zip(zip(knots, knots[1:]), parts))):
            end, done = done, done - part
            r = F.greatest(q * F.lit(whole) - F.lit(done), F.lit(0.0)) / F.lit(t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * (w1 - w0)) * r, F.lit(0.0)))
            u = F.when(r > 0, F.lit(2.0) * r / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            here = F.lit(t0) + F.least(u, F.lit(1.0)) * F.lit(t1 - t0)
            at = here if at is None else F.when(q * F.lit(whole) < F.lit(end), here).otherwise(at)
        out = F.when(slot == s, at).otherwise(out)
    return out


def plan_mix(docs: DataFrame, curriculum: Curriculum = Curriculum(), *, whole: bool = False,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken, passes, position``.

    A source is read in hash order of its ids, again and again up to ``max_repeat`` times, until its
    target is met. ``passes`` lists (pass, words, position) of the readings that take words; ``taken``
    is their sum. The last reading is cut at the target, or with ``whole`` the document that holds the
    target is taken if its middle lies before it. Rows are range-sorted by the first position, then id;
    documents that are not taken come last.

    Null text counts as empty and is never taken, a very long one is a row like any other; null sources form one source; null
    ids hash like an empty string; rows of one id are read next to each other in the order of their sizes, each as a
    document of its own, and are spread over tasks if they are many; an empty table gives an empty result. Other columns,
    whatever their names, are not read. ``row_col`` names a column that tells all rows apart; it is then returned as ``row``.
    """
    c = curriculum
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row.alias("row"))
    sizes = stored(sizes, "sizes")
    targets = stored(source_targets(sizes, c), "targets")
    rows = with_lookup(sizes, targets, ["source"]).withColumn("__h", hash60(F.col("doc_id")))
    rows = sliced_running_sum(rows, ["source"], "__h", ["doc_id", "size"], "size", "__before", spread="row")
    budget = F.floor(F.col("target") + F.lit(0.5))
    rows = rows.withColumn("__budget", budget.cast("long"))
    size, total = F.col("size"), F.col("__budget")

    def one(k: int) -> Column:
        start = F.col("__before") + F.lit(k) * F.col("source_size")
        if whole:
            words = F.when(F.lit(2) * start + size <= F.lit(2) * total, size).otherwise(F.lit(0))
        else:
            words = F.greatest(F.least(total - start, size), F.lit(0))
        middle = F.least((start.cast("double") + words / F.lit(2.0)) / F.greatest(total, F.lit(1)), F.lit(1.0))
        return F.struct(F.lit(k).alias("pass"), words.cast("long").alias("words"), _position(F.col("slot"), middle, c).alias("position"))

    rows = rows.withColumn("passes", F.filter(F.array(*[one(k) for k in range(c.max_repeat)]), lambda p: p["words"] > 0))
    rows = rows.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
    rows = rows.withColumn("position", F.when(F.size("passes") > 0, F.col("passes")[0]["position"]))
    names = ["doc_id", "size", "source", "source_size", "target", "taken", "passes", "position"] + (["row"] if row_col is not None else [])
    return rows.select(*names).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def apply_mix(docs: DataFrame, curriculum: Curriculum = Curriculum(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with their own columns, one row for each reading of a whole-document plan, in range-sorted training order.

    The plan is joined by the row's place, not by the id: null ids and repeated ids or rows are read as often as the plan says
    for each row. Null and empty texts take no words and are never read; an empty table gives an empty result; columns of any
    other name are carried along.
    """
    rows = keyed(docs)
    names = {id_col: "doc_id", text_col: "text", source_col: "source"}
    plan = plan_mix(rows.select("row", *[F.col(f"doc.`{c}`").alias(n) for c, n in names.items()]), curriculum, whole=True, row_col="row")
    readings = stored(plan.select("row", F.explode(F.col("passes.position")).alias("at")), "readings")
    return rows.join(readings, "row").orderBy("at", "row").select("doc.*")

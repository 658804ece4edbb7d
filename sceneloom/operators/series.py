"""Time sampling and time series of poses. Times are seconds; nothing is extrapolated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_frames(frames: DataFrame, fps: float, start: Column, max_s: float, keys: list[str], t: str = "t", index: str = "event_id") -> DataFrame:
    """The last frame of each sampling bucket: keys, bucket, index, t since start. Half a bucket rounds up."""
    since = F.col(t) - start
    bucket = F.floor(since * F.lit(fps) + F.lit(0.5))
    rows = frames.withColumn("__since", since).withColumn("bucket", bucket.cast("long")).where(F.col("bucket").between(0, int(-(-max_s * fps // 1)) - 1))
    return rows.groupBy(*keys, "bucket").agg(F.max_by("__since", index).alias("t"), F.max(index).alias(index))


def pick_uniform(rows: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """At most n rows a group at evenly spaced ranks (half to even), both ends included."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("__i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(by))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / F.lit(float(max(n - 1, 1))), 0).cast("long"))
    return ranked.where((F.col("__n") <= n) | F.array_contains(picks, F.col("__i").cast("long"))).drop("__i", "__n")


def select_keyframes(rows: DataFrame, k: int, keys: list[str], order: list[str], motion: str) -> DataFrame:
    """Frames at which the running share of motion first reaches each of k targets, with the first and last; k at most."""
    by = Window.partitionBy(*keys)
    w = rows.withColumn("__w", F.col(motion) + 0.25 * F.avg(motion).over(by) + F.lit(1e-6))
    w = w.withColumn("__i", F.row_number().over(by.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(by))
    running = F.sum("__w").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("__share", running / F.sum("__w").over(by))
    w = w.withColumn("__before", F.coalesce(F.lag("__share").over(by.orderBy(*order)), F.lit(-1.0)))
    crossed = F.exists(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: j / F.lit(float(max(k - 1, 1)))), lambda x: (x > F.col("__before")) & (x <= F.col("__share")))
    marked = w.where(crossed | (F.col("__i") == 1) | (F.col("__i") == F.col("__n")))
    return marked.withColumn("__r", F.row_number().over(by.orderBy(*order))).where(F.col("__r") <= k).drop("__w", "__i", "__n", "__share", "__before", "__r")


def build_tracks(states: DataFrame, keys: list[str], t: str = "t", values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One row per instance: samples, span, and why it is invalid (repeated time, non-finite position) or null."""
    bad = F.lit(False)
    for v in values:
        bad = bad | F.col(v).isNull() | F.isnan(v) | (F.abs(F.col(v)) == F.lit(float("inf")))
    step = F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    rows = states.withColumn("__still", (F.col(t) - step) <= 0).withColumn("__bad", bad)
    reason = F.when(F.max(F.coalesce("__still", F.lit(False))), "repeated_time").when(F.max("__bad"), "non_finite_position")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min(t).alias("t_start"), F.max(t).alias("t_end"), reason.alias("reason"))


def resample_linear(track: DataFrame, times: DataFrame, keys: list[str], t: str = "t", values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Values at the query times, linear between the neighbours; null outside the measured support.

    Samples and queries are ordered together once per key, so no pair of them is ever joined.
    """
    samples = track.select(*keys, F.col(t).alias("t"), *values, F.lit(0).alias("__q"))
    asks = times.select(*keys, F.col(t).alias("t"), *[F.lit(None).cast("double").alias(v) for v in values], F.lit(1).alias("__q"))
    back = Window.partitionBy(*keys).orderBy("t", "__q").rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(*keys).orderBy(F.col("t").desc(), "__q").rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("__q") == 0, F.struct("t", *values))
    rows = samples.union(asks).withColumn("__a", F.last(point, True).over(back)).withColumn("__b", F.last(point, True).over(fore))

    def at(v: str) -> Column:
        gap = F.col("__b.t") - F.col("__a.t")
        return F.when(gap > 0, F.col(f"__a.{v}") + (F.col(f"__b.{v}") - F.col(f"__a.{v}")) * (F.col("t") - F.col("__a.t")) / gap).otherwise(F.col(f"__a.{v}"))

    inside = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return rows.where("__q = 1").select(*keys, "t", *[F.when(inside, at(v)).alias(v) for v in values])


def nearest_time_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float, t: str = "t") -> DataFrame:
    """For each left row the right row nearest in time within the tolerance; the earlier one of a tie."""
    a = left.select(*keys, F.col(t).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("__q"))
    b = right.select(*keys, F.col(t).alias("t"), F.col(value).cast("double").alias("v"), F.lit(0).alias("__q"))
    back = Window.partitionBy(*keys).orderBy("t", "__q").rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(*keys).orderBy(F.col("t").desc(), "__q").rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("__q") == 0, F.struct("t", "v"))
    rows = a.union(b).withColumn("__p", F.last(point, True).over(back)).withColumn("__n", F.last(point, True).over(fore)).where("__q = 1")
    gp, gn = F.col("t") - F.col("__p.t"), F.col("__n.t") - F.col("t")
    first = gn.isNull() | (gp <= gn)
    best = F.when(gp.isNotNull() & first, F.col("__p")).otherwise(F.col("__n"))
    rows = rows.withColumn("__m", best).withColumn("gap", F.abs(F.col("__m.t") - F.col("t")))
    ok = F.col("gap") <= tolerance
    return rows.select(*keys, "t", F.when(ok, F.col("__m.t")).alias("match_t"), F.when(ok, F.col("__m.v")).alias(value), F.when(ok, F.col("gap")).alias("gap"))


def coverage_window(pairs: DataFrame, t0: str, t1: str, a0: str, a1: str, b0: str, b1: str, least: float = 0.9) -> DataFrame:
    """Part of the window [t0, t1] that both tracks support, and whether that is enough; null bounds give no coverage."""
    lo, hi = F.greatest(F.col(t0), F.col(a0), F.col(b0)), F.least(F.col(t1), F.col(a1), F.col(b1))
    known = F.col(a0).isNotNull() & F.col(b0).isNotNull()
    share = F.greatest(hi - lo, F.lit(0.0)) / (F.col(t1) - F.col(t0))
    out = pairs.withColumn("coverage", F.when(known & (F.col(t1) > F.col(t0)), share))
    status = F.when(F.col("coverage").isNull() | (F.col("coverage") <= 0), "unavailable").when(F.col("coverage") >= least, "complete").otherwise("partial")
    return out.withColumn("status", status)


def holdout_cut(states: DataFrame, keys: list[str], frac: float = 0.2, t: str = "t") -> DataFrame:
    """Rows with their clip's cut and window: samples after the cut are held out before anything is fitted."""
    by = Window.partitionBy(*keys)
    t0, t1 = F.min(t).over(by), F.max(t).over(by)
    return states.withColumn("cut", t0 + (t1 - t0) * F.lit(1 - frac)).withColumn("window", F.when(F.col(t) <= F.col("cut"), "fit").otherwise("holdout"))


def moving_average(rows: DataFrame, keys: list[str], order: list[str], value: str, win: int, into: str = "smooth") -> DataFrame:
    """Centred mean over an odd window (at most the series length), ends repeated."""
    by = Window.partitionBy(*keys)
    o = by.orderBy(*order)
    n = F.count(F.lit(1)).over(by)
    i = F.row_number().over(o)
    out = rows.withColumn("__n", n).withColumn("__i", i).withColumn("__first", F.first(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.withColumn("__last", F.last(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    result = F.col(value)
    for w in range(3, win + 1, 2):
        h = w // 2
        mean = (
            F.sum(value).over(o.rowsBetween(-h, h)) + F.greatest(F.lit(h) - (F.col("__i") - 1), F.lit(0)) * F.col("__first")
            + F.greatest(F.lit(h) - (F.col("__n") - F.col("__i")), F.lit(0)) * F.col("__last")
        ) / F.lit(float(w))
        result = F.when((F.col("__n") >= w) & ((F.lit(w) == win) | (F.col("__n") < w + 2)), mean).otherwise(result)
    return out.withColumn(into, result).drop("__n", "__i", "__first", "__last")


def heading_step(width: Column, depth: Column) -> Column:
    """Degrees after which a box looks the same: half a turn, or a quarter if it is nearly square (aspect under 1.6)."""
    aspect = F.greatest(width, depth) / F.greatest(F.least(width, depth), F.lit(1e-9))
    return F.when(aspect < 1.6, 90.0).otherwise(180.0)


def unwrap_angle(rows: DataFrame, keys: list[str], order: list[str], angle: str, step: float | Column, into: str = "unwrapped") -> DataFrame:
    """A continuous angle equal to the input modulo ``step`` (constant in a track): the running sum of wrapped differences."""
    o = Window.partitionBy(*keys).orderBy(*order)
    d = F.col(angle) - F.lag(angle).over(o)
    turn = step if isinstance(step, Column) else F.lit(step)
    wrapped = d - turn * F.floor(d / turn + F.lit(0.5))
    rows = rows.withColumn("__d", F.coalesce(wrapped, F.col(angle)))
    return rows.withColumn(into, F.sum("__d").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def track_filter(observed: DataFrame, clip: list[str], track: str, frame: str, least: float = 0.3, keep: int = 3) -> DataFrame:
    """Frames seen of each track, its part of the clip's frames, and whether it stays: enough, or among the longest."""
    seen = observed.groupBy(*clip, track).agg(F.countDistinct(frame).alias("frames"))
    frames = observed.groupBy(*clip).agg(F.countDistinct(frame).alias("registered"))
    joined = seen.join(frames, clip).withColumn("fraction", F.col("frames") / F.col("registered"))
    rank = F.row_number().over(Window.partitionBy(*clip).orderBy(F.desc("frames"), track))
    return joined.withColumn("kept", (F.col("fraction") >= least) | (rank <= keep))


def contiguity(observed: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Frames of a track over the length of its range."""
    return observed.groupBy(*keys).agg(F.countDistinct(frame).alias("frames"), (F.countDistinct(frame) / (F.max(frame) - F.min(frame) + 1)).alias("contiguity"))


def contiguity_profile(tracks: DataFrame, matched: str, short: int = 5) -> DataFrame:
    """Quartiles of ``contiguity`` of short and long tracks (by ``frames``), matched and not."""
    kind = F.when(F.col("frames") < short, "short").otherwise("long")
    q = F.percentile("contiguity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = tracks.groupBy(kind.alias("length"), F.col(matched).alias("matched")).agg(F.count(F.lit(1)).alias("tracks"), q.alias("__q"))
    return out.select("length", "matched", "tracks", *[F.col("__q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def along_track(rows: DataFrame, keys: list[str], t: str, values: tuple[str, ...], into: str = "along") -> DataFrame:
    """Add the place of each sample along the direction from the track's first to its last one; 0 where they coincide."""
    whole = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = [F.first(v).over(whole) for v in values], [F.last(v).over(whole) for v in values]
    steps = [b - a for a, b in zip(first, last)]
    size = F.sqrt(sum((d * d for d in steps), F.lit(0.0)))
    dot = sum(((F.col(v) - a) * d for v, a, d in zip(values, first, steps)), F.lit(0.0))
    return rows.withColumn(into, F.when(size > 0, dot / size).otherwise(0.0))


def velocity_structure(rows: DataFrame, keys: list[str], t: str, value: str, least: int = 6) -> DataFrame:
    """Reversals and rest share of a motion along its first-to-last direction; tracks of ``least`` samples or more.

    ``value`` is a coordinate, or the place along the track that ``along_track`` adds."""
    o = Window.partitionBy(*keys).orderBy(t)
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("__n") >= least)
    d = d.withColumn("__dir", F.signum(F.last(value).over(whole) - F.first(value).over(whole)))
    d = d.withColumn("v", F.col("__dir") * (F.col(value) - F.lag(value).over(o)) / (F.col(t) - F.lag(t).over(o))).where("v is not null")
    d = d.withColumn("__max", F.max(F.abs("v")).over(Window.partitionBy(*keys)))
    d = d.withColumn("__fast", F.abs("v") > 0.1 * F.col("__max"))
    # The sign of the last fast step before this one.
    before = F.last(F.when(F.col("__fast"), F.signum("v")), True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__turn", F.col("__fast") & (F.signum("v") != before))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("__turn").alias("reversals"), F.avg((F.abs("v") < 0.1 * F.col("__max")).cast("double")).alias("rest_share")
    )


def jitter(rows: DataFrame, keys: list[str], values: tuple[str, ...], least: int = 4, size: tuple[str, ...] = ()) -> DataFrame:
    """RMS distance of positions to their median centre; with the edges of ``size`` over the diagonal of the median box (null if it has none)."""
    centres = rows.groupBy(*keys).agg(*[F.percentile(v, F.lit(0.5)).alias(f"__{v}") for v in (*values, *size)], F.count(F.lit(1)).alias("samples")).where(F.col("samples") >= least)
    far = sum((F.pow(F.col(v) - F.col(f"__{v}"), 2) for v in values), F.lit(0.0))
    diagonal = F.sqrt(sum((F.pow(F.col(f"__{v}"), 2) for v in size), F.lit(0.0))) if size else F.lit(1.0)
    unit = F.when(diagonal > 1e-9, diagonal)
    out = rows.join(centres, keys).groupBy(*keys).agg(F.first("samples").alias("samples"), F.sqrt(F.avg(far)).alias("jitter"), F.first(unit).alias("__unit"))
    return out.withColumn("jitter", F.col("jitter") / F.col("__unit")).drop("__unit")


def drift_by_phase(rows: DataFrame, keys: list[str], order: list[str], error: str, phases: int = 5) -> DataFrame:
    """Mean error by equal parts of a track's order."""
    by = Window.partitionBy(*keys)
    i, n = F.row_number().over(by.orderBy(*order)) - 1, F.count(F.lit(1)).over(by)
    phase = F.floor(F.lit(phases) * i / n).cast("int")
    return rows.withColumn("phase", phase).groupBy("phase").agg(F.avg(error).alias("error"), F.count(F.lit(1)).alias("n"))

"""Declared motions evaluated as pure functions of time: schedules with holds, key frames, swings and turns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from sceneloom.functions.columns import let, quat_multiply


def schedule_value(schedule: Column, start: Column, t: Column, duration: float = 1.0) -> Column:
    """Value at t of ``array<struct<t, to, duration>>``: holds between moves, each move linear over its duration.

    A move that has begun ends the search, a later one whose time has come starts from where the last one aimed.
    """
    state = F.struct(start.cast("double").alias("value"), start.cast("double").alias("prev"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        d = F.coalesce(s["duration"], F.lit(duration))
        early, moving = t < s["t"], t < s["t"] + d
        value = F.when(a["done"] | early, a["value"]).when(moving, a["prev"] + (s["to"] - a["prev"]) * ((t - s["t"]) / d)).otherwise(s["to"])
        prev = F.when(a["done"] | early | moving, a["prev"]).otherwise(s["to"])
        return F.struct(value.cast("double").alias("value"), prev.cast("double").alias("prev"), (a["done"] | moving).alias("done"))

    return F.aggregate(F.coalesce(schedule, F.array().cast("array<struct<t:double,to:double,duration:double>>")), state, step, lambda a: a["value"])


def keyframe_position(keyframes: Column, t: Column) -> Column:
    """Position at t on straight lines between key frames ``array<struct<t, pos>>``; the ends hold."""
    later = F.filter(keyframes, lambda k: k["t"] >= t)
    at = F.greatest(F.size(keyframes) - F.size(later) - 1, F.lit(0))
    a, b = F.get(keyframes, at), F.get(keyframes, F.least(at + 1, F.size(keyframes) - 1))
    u = F.greatest(F.least((t - a["t"]) / F.greatest(b["t"] - a["t"], F.lit(1e-6)), F.lit(1.0)), F.lit(0.0))
    return F.zip_with(a["pos"], b["pos"], lambda x, y: x + (y - x) * u)


def slerp(a: Column, b: Column, u: Column) -> Column:
    """The rotation the part ``u`` of the short way from unit quaternion ``a`` to ``b`` (arrays x, y, z, w); nearly equal ones are mixed linearly."""
    def dot(s: Column) -> Column:
        return F.aggregate(F.zip_with(s["a"], s["b"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    def weights(s: Column, d: Column) -> Column:
        sign = F.when(d < 0, -1.0).otherwise(1.0)
        sine = F.sqrt(F.greatest(1 - d * d, F.lit(0.0)))
        even = F.struct((1 - s["u"]).alias("a"), (s["u"] * sign).alias("b"))
        return let(F.struct(sine.alias("sine"), F.atan2(sine, F.abs(d)).alias("half")), lambda h: F.when(h["sine"] <= 1e-8, even).otherwise(
            F.struct((F.sin((1 - s["u"]) * h["half"]) / h["sine"]).alias("a"), (sign * F.sin(s["u"] * h["half"]) / h["sine"]).alias("b"))))

    def mixed(s: Column) -> Column:
        return let(dot(s), lambda d: let(weights(s, d), lambda w: F.zip_with(s["a"], s["b"], lambda x, y: w["a"] * x + w["b"] * y)))

    return unit_quaternion(let(F.struct(a.alias("a"), b.alias("b"), u.alias("u")), mixed))


def unit_quaternion(q: Column) -> Column:
    """A quaternion of length one; the identity if it has no direction."""
    same = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    def scaled(p: Column) -> Column:
        return let(F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 1e-12, F.transform(p, lambda x: x / n)).otherwise(same))

    return let(q, scaled)


def keyframe_orientation(keyframes: Column, base: Column, t: Column) -> Column:
    """Orientation at t between key frames ``array<struct<t, pos, quat>>``, the short way round; a frame without one has the ``base``, the ends hold."""
    last = F.size(keyframes) - 1
    before = F.size(F.filter(keyframes, lambda k: k["t"] < t)) - 1

    def between(at: Column) -> Column:
        return F.struct(F.get(keyframes, at).alias("a"), F.get(keyframes, F.least(at + 1, last)).alias("b"))

    def turned(s: Column) -> Column:
        u = F.greatest(F.least((t - s["a"]["t"]) / F.greatest(s["b"]["t"] - s["a"]["t"], F.lit(1e-6)), F.lit(1.0)), F.lit(0.0))
        return slerp(unit_quaternion(F.coalesce(s["a"]["quat"], base)), unit_quaternion(F.coalesce(s["b"]["quat"], base)), u)

    return let(let(F.greatest(before, F.lit(0)), between), turned)


def _centripetal(times: np.ndarray, points: np.ndarray, t: float) -> np.ndarray:
    """Centripetal Catmull-Rom through the neighbouring four key frames; end tangents are mirrored."""
    n = len(times)
    if n == 1 or t <= times[0]:
        return points[0]
    if t >= times[-1]:
        return points[-1]
    i = min(max(int(np.searchsorted(times, t, side="left")) - 1, 0), n - 2)
    p = [points[max(i - 1, 0)], points[i], points[i + 1], points[min(i + 2, n - 1)]]
    u = (t - times[i]) / max(times[i + 1] - times[i], 1e-6)
    d = [max(float(((b - a) ** 2).sum()) ** 0.25, 0.0) for a, b in zip(p, p[1:])]
    middle = d[1] if d[1] >= 1e-4 else 1.0
    first, last = (d[0] if d[0] >= 1e-4 else middle), (d[2] if d[2] >= 1e-4 else middle)
    m1 = ((p[1] - p[0]) / first - (p[2] - p[0]) / (first + middle) + (p[2] - p[1]) / middle) * middle
    m2 = ((p[2] - p[1]) / middle - (p[3] - p[1]) / (middle + last) + (p[3] - p[2]) / last) * middle
    return p[1] + m1 * u + (3 * (p[2] - p[1]) - 2 * m1 - m2) * u**2 + (2 * (p[1] - p[2]) + m1 + m2) * u**3


@pandas_udf(ArrayType(DoubleType()))
def smooth_position(times: pd.Series, points: pd.Series, t: pd.Series) -> pd.Series:
    """Position at t on a smooth curve through key frames: ``times`` and ``points`` are arrays."""
    return pd.Series([None if k is None or not len(k) else _centripetal(np.asarray(k, float), np.stack([np.asarray(x, float) for x in p]), float(x0)).tolist() for k, p, x0 in zip(times, points, t)])


def sample_motion(nodes: DataFrame, times: Column) -> DataFrame:
    """Poses of ``nodes(clip, node, motion, pos, quat, axis, start, rate, amp, period, phase, schedule, keyframes, smooth)`` at an array of times.

    prismatic and revolute follow their schedule, or a constant rate without one; periodic ones swing about the base; spin turns; a
    trajectory follows its key frames, and their orientations if they have any. Rotations turn the base orientation about the axis; static and
    dynamic stay.
    """
    rows = nodes.withColumn("t", F.explode(times))
    t, m = F.col("t"), F.col("motion")
    norm = F.sqrt(F.aggregate("axis", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("axis", lambda x: x / F.greatest(norm, F.lit(1e-12)))
    told = F.when(F.size("schedule") > 0, schedule_value(F.col("schedule"), F.col("start"), t)).otherwise(F.col("start") + F.col("rate") * t)
    swing = F.col("amp") * F.sin(F.lit(2 * math.pi) * t / F.greatest("period", F.lit(1e-3)) + F.col("phase"))
    shift = F.when(m == "prismatic", told).when(m == "periodic_translate", swing).otherwise(0.0)
    angle = F.when(m == "revolute", told).when(m == "periodic_rotate", swing).when(m == "spin", F.col("rate") * t).otherwise(0.0)
    rows = rows.withColumns({"__unit": unit, "__shift": shift, "angle_deg": angle})
    path = F.when(F.col("smooth"), smooth_position(F.col("keyframes.t"), F.col("keyframes.pos"), t)).otherwise(keyframe_position(F.col("keyframes"), t))
    moved = F.zip_with("pos", "__unit", lambda p, a: p + a * F.col("__shift"))
    half = F.radians("angle_deg") / 2
    turn = [F.sin(half) * F.col("__unit")[i] for i in range(3)] + [F.cos(half)]
    quat = F.array(*quat_multiply(turn, [F.col("quat")[i] for i in range(4)]))
    here = F.when((m == "trajectory") & (F.size("keyframes") > 0), path).otherwise(moved)
    turned = nodes.schema["keyframes"].dataType.elementType.fieldNames()
    if "quat" in turned:
        quat = F.when((m == "trajectory") & (F.size("keyframes") > 0), keyframe_orientation(F.col("keyframes"), F.col("quat"), t)).otherwise(quat)
    return rows.select("clip", "node", "t", here.alias("pos"), quat.alias("quat"), "angle_deg")


SCHEDULE = "array<struct<t:double,to:double,duration:double>>"


def motion_from_guess(guesses: DataFrame, track: DataFrame, keys: list[str], frames: int = 12) -> DataFrame:
    """Parameters of declared motions from guesses and observed centres, one row per object: ``keys, motion, pos, axis, start, rate, amp, period, phase,
    pivot, range_deg, schedule, keyframes``.

    ``guesses(keys, type, axis, amp, amp_deg, period, phase, rate, pivot, range_deg)``, ``track(keys, t, x, y, z)``. An oscillation is centred at the mean
    of the track, and of the two phases that give its first value the one that gives its first movement is taken. A hinge turns once, to its
    largest angle, over the time it was seen. What is left moves along ``frames`` key frames at even places. Static and unknown guesses and tracks of one
    sample give nothing.
    """
    o = F.array_sort(F.collect_list(F.struct("t", "x", "y", "z")))
    rows = guesses.where("type NOT IN ('static', 'unknown')").join(track.groupBy(*keys).agg(o.alias("seen"), *[F.avg(c).alias(f"m{c}") for c in "xyz"]), keys).where("size(seen) >= 2")
    n, kind = F.size("seen"), F.col("type")
    first, last = F.get("seen", F.lit(0)), F.element_at("seen", -1)
    axis = F.coalesce("axis", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    along = lambda s: sum((F.get(axis, F.lit(i)) * (s[c] - F.col(f"m{c}")) for i, c in enumerate("yz", 1)), F.get(axis, F.lit(0)) * (s["x"] - F.col("mx")))
    amp = F.greatest(F.coalesce(F.when(F.col("amp") != 0, F.col("amp")), F.lit(0.1)), F.lit(1e-3))
    phi = F.asin(F.greatest(F.least(along(first) / amp, F.lit(1.0)), F.lit(-1.0)))
    ahead = along(F.get("seen", F.least(n - 1, F.lit(2)))) - along(first)
    phi = F.when(F.cos(phi) * ahead < 0, F.lit(math.pi) - phi).otherwise(phi)
    given = lambda c, other: F.coalesce(F.when(F.col(c) != 0, F.col(c)), other)
    span = last["t"] - first["t"]
    hinge = (kind == "revolute") & F.col("pivot").isNotNull()
    motion = F.when(kind.isin("periodic_translate", "periodic_rotate", "spin"), kind).when(hinge, "revolute").otherwise("trajectory")
    most = F.greatest(F.coalesce(F.get("range_deg", F.lit(1)), F.lit(90.0)), F.lit(5.0))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(frames - 1)), 0).cast("int")))
    even = F.when(n <= frames, F.sequence(F.lit(0), n - 1)).otherwise(places)
    path = F.transform(even, lambda i: F.struct(F.get("seen", i)["t"].alias("t"), F.array(*[F.get("seen", i)[c] for c in "xyz"]).alias("pos")))
    is_ = lambda *k: F.col("motion").isin(*k)
    up = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    out = rows.withColumn("motion", motion)
    return out.select(
        *keys, "motion", F.when(is_("periodic_translate", "periodic_rotate"), F.array("mx", "my", "mz")).alias("pos"),
        F.when(is_("periodic_translate"), axis).when(~is_("trajectory"), up).alias("axis"), F.when(is_("revolute"), F.lit(0.0)).alias("start"),
        F.when(is_("spin"), given("rate", F.lit(90.0))).alias("rate"), F.when(is_("periodic_translate"), amp).when(is_("periodic_rotate"), given("amp_deg", F.lit(30.0))).alias("amp"),
        F.when(is_("periodic_translate"), F.col("period")).when(is_("periodic_rotate"), given("period", F.greatest(span, F.lit(1.0)) * 2)).alias("period"),
        F.when(is_("periodic_translate"), phi - 2 * math.pi * first["t"] / F.col("period")).when(is_("periodic_rotate"), F.coalesce("phase", F.lit(0.0))).alias("phase"),
        F.when(is_("revolute"), F.col("pivot")).alias("pivot"), F.when(is_("revolute"), F.array(F.lit(0.0), most)).alias("range_deg"),
        F.when(is_("revolute"), F.array(F.struct(first["t"].alias("t"), most.alias("to"), F.greatest(span, F.lit(0.5)).alias("duration")))).cast(SCHEDULE).alias("schedule"),
        F.when(is_("trajectory"), path).alias("keyframes"),
    )

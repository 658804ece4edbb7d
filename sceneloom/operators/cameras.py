"""New camera paths of clips: orbits pulled closer, walks past the objects, and arcs around one of them (P15).

A path is a row per key frame: ``clip, view, name, t, x, y, z, lx, ly, lz`` (position and what is looked at). All chance is a
hash of the clip's seed, the view and the purpose, so a path does not depend on partitions or on other clips.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nearest distance to what is looked at, lowest height of a camera, least size of an object, field of view if unknown.
NEAREST = 0.35
LOWEST = 0.25
LEAST_SIZE = 0.05
FIELD_OF_VIEW = 60.0


@dataclass(frozen=True)
class Path:
    """``closeness`` of an orbit, ``fraction`` of the picture's height that an object fills, ``count`` key frames of a new path,
    ``height`` of a walk and ``standoff`` of its way-points from the objects."""

    closeness: float = 0.35
    fraction: float = 0.3
    count: int = 9
    height: float = 0.9
    standoff: float = 0.8


def with_views(clips: DataFrame, views: int, base_seed: int) -> DataFrame:
    """A row per clip and view: ``view``, ``name`` (the clip's own where it has one view) and ``seed``."""
    head = F.conv(F.substring(F.sha2(F.col("clip").cast("string"), 256), 1, 8), 16, 10).cast("long")
    own = F.col("clip").cast("string")
    return clips.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1)))).withColumns({
        "name": F.concat(own, F.lit("_v"), F.col("view").cast("string")) if views > 1 else own, "seed": F.lit(base_seed).cast("long").bitwiseXOR(head),
    })


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of its parts."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _chance(purpose: str) -> Column:
    return uniform(F.col("seed"), F.col("view"), F.lit(purpose))


def anchor_size(extent: Column, radius: Column, height: Column) -> Column:
    """Longest edge of a node, else twice its radius or height (0.3 without either)."""
    round_ = F.coalesce(F.when(radius != 0, radius), F.when(height != 0, height), F.lit(0.3)) * 2
    return F.greatest(F.when(F.size(extent) == 3, F.array_max(extent)).otherwise(round_), F.lit(LEAST_SIZE))


def distance_for_fraction(size: Column, field_of_view: Column, fraction: float) -> Column:
    """How far away a pinhole camera sees an object fill the part ``fraction`` of the picture's height."""
    return F.greatest(F.lit(NEAREST), size / (F.tan(F.radians(field_of_view) / 2) * (2 * max(fraction, 1e-3))))


def _lifted(y: Column) -> Column:
    return F.greatest(y, F.lit(LOWEST))


PATH = ("clip", "view", "name", "t", "x", "y", "z", "lx", "ly", "lz")


def near_orbit(frames: DataFrame, views: int, path: Path = Path(), turned: bool = True) -> DataFrame:
    """The clip's own path, pulled to ``closeness`` of its distance; further views are turned about what is looked at unless ``turned`` is off.

    ``frames(clip, view, name, t, x, y, z, lx, ly, lz)``: the clip's key frames for each view. A key frame that looks at its own place
    is not pulled.
    """
    look = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("lx", "ly", "lz")}
    rows = frames.withColumns(look)
    away = [F.col(p) - F.col(q) for p, q in (("x", "lx"), ("y", "ly"), ("z", "lz"))]
    far = F.sqrt(sum((a * a for a in away), F.lit(0.0)))
    rows = rows.withColumn("__far", far)
    pulled = F.col("__far") >= 1e-6
    factor = F.when(pulled, F.greatest(F.lit(NEAREST), F.col("__far") * path.closeness) / F.col("__far")).otherwise(F.lit(1.0))
    dx, dy, dz = (a * factor for a in away)
    again = (F.col("view") > 0) & F.lit(turned)
    turn = F.when(again, F.lit(2 * math.pi) * F.col("view") / F.lit(float(views))).otherwise(F.lit(0.0))
    y = F.col("ly") + dy
    return rows.select(
        "clip", "view", "name", "t", (F.col("lx") + dx * F.cos(turn) - dz * F.sin(turn)).alias("x"), F.when(pulled | again, _lifted(y)).otherwise(y).alias("y"),
        (F.col("lz") + dx * F.sin(turn) + dz * F.cos(turn)).alias("z"), "lx", "ly", "lz",
    )


def _samples(rows: DataFrame, count: int) -> DataFrame:
    """A row per key frame, with ``u`` from 0 to 1 and ``t``."""
    u = F.col("__i") / F.lit(float(count - 1)) if count > 1 else F.lit(0.0)
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("u", u).withColumn("t", F.col("duration") * F.col("u"))


def walkthrough(clips: DataFrame, anchors: DataFrame, path: Path = Path()) -> DataFrame:
    """A low walk past all objects of a clip in an order of chance, each time looking at the next one.

    ``clips(clip, view, name, seed, duration)``, ``anchors(clip, node, x, y, z)``: places at the start. Clips without anchors have no row.
    A clip's objects are gathered as an array of places.
    """
    stops = clips.join(anchors, "clip").withColumns({
        "__order": uniform(F.col("seed"), F.col("view"), F.lit("order"), F.col("node")), "__turn": F.lit(2 * math.pi) * uniform(F.col("seed"), F.col("view"), F.lit("stop"), F.col("node")),
    })
    one = F.struct("__order", "node", "x", "y", "z", (F.col("x") + path.standoff * F.cos("__turn")).alias("wx"), (F.col("z") + path.standoff * F.sin("__turn")).alias("wz"))
    rows = stops.groupBy("clip", "view", "name", "seed", "duration").agg(F.array_sort(F.collect_list(one)).alias("stops"))
    place = lambda x, z: F.struct(x.alias("wx"), z.alias("wz"))
    way = F.transform("stops", lambda s: place(s["wx"], s["wz"]))
    end = F.lit(2 * math.pi) * _chance("end")
    first = F.col("stops")[0]
    rows = rows.withColumn("way", F.when(F.size("stops") > 1, way).otherwise(
        F.array(place(first["wx"], first["wz"]), place(first["wx"] + 2 * path.standoff * F.cos(end), first["wz"] + 2 * path.standoff * F.sin(end)))))
    rows = _samples(rows, path.count).withColumn("__s", F.col("u") * (F.size("way") - 1))
    rows = rows.withColumn("__j", F.least(F.floor("__s").cast("int"), F.size("way") - 2))
    rows = rows.withColumns({
        "__f": F.col("__s") - F.col("__j"), "__a": F.get("way", F.col("__j")), "__b": F.get("way", F.col("__j") + 1),
        "__look": F.get("stops", F.least(F.col("__j") + 1, F.size("stops") - 1)),
    })
    along = lambda c: F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * F.col("__f")
    return rows.select("clip", "view", "name", "t", along("wx").alias("x"), _lifted(F.lit(path.height)).alias("y"), along("wz").alias("z"),
                       *[F.col(f"__look.{c}").alias(f"l{c}") for c in "xyz"])


def object_centric(clips: DataFrame, anchors: DataFrame, path: Path = Path()) -> DataFrame:
    """An arc around one object of a clip, from where it fills ``fraction`` of the picture; views take the objects in turn.

    ``clips(clip, view, name, seed, duration, fov_deg)``, ``anchors(clip, node, x, y, z, size)``: the object's place at the start is kept in
    the middle, its motion is not followed. Clips without anchors have no row.
    """
    order = F.array_sort(F.collect_list(F.struct("node", "x", "y", "z", "size")))
    rows = clips.join(anchors.groupBy("clip").agg(order.alias("stops")), "clip")
    rows = rows.withColumn("__o", F.get("stops", F.pmod(F.col("view"), F.size("stops"))))
    rows = rows.withColumn("__d", distance_for_fraction(F.col("__o.size"), F.coalesce(F.col("fov_deg"), F.lit(FIELD_OF_VIEW)), path.fraction))
    rows = rows.withColumns({
        "__start": F.lit(2 * math.pi) * _chance("start"), "__rise": (F.lit(0.25) + F.lit(0.5) * _chance("rise")) * F.col("__d"),
        "__sweep": F.when(_chance("side") < 0.5, F.lit(-math.pi)).otherwise(F.lit(math.pi)) * (F.lit(0.5) + F.lit(0.6) * _chance("sweep")),
    })
    rows = _samples(rows, path.count)
    angle = F.col("__start") + F.col("__sweep") * F.col("u")
    return rows.select("clip", "view", "name", "t", (F.col("__o.x") + F.col("__d") * F.cos(angle)).alias("x"), _lifted(F.col("__o.y") + F.col("__rise")).alias("y"),
                       (F.col("__o.z") + F.col("__d") * F.sin(angle)).alias("z"), *[F.col(f"__o.{c}").alias(f"l{c}") for c in "xyz"])


def camera_paths(clips: DataFrame, frames: DataFrame, anchors: DataFrame, mode: str, views: int, base_seed: int, path: Path = Path()) -> DataFrame:
    """Key frames of all views of all clips in one mode: ``near_orbit``, ``walkthrough`` or ``object_centric``.

    ``clips(clip, duration, fov_deg)``, one row each; ``frames(clip, t, x, y, z, lx, ly, lz)``, the clips' own cameras; ``anchors`` as
    above. A clip without anchors keeps its camera on a walk, and gets its orbit, not turned, where an object should be circled.
    """
    if mode not in ("near_orbit", "walkthrough", "object_centric"):
        raise ValueError(f"unknown camera mode {mode}")
    seen = with_views(clips, views, base_seed)
    own = seen.select("clip", "view", "name")
    if mode == "near_orbit":
        return near_orbit(frames.join(own, "clip"), views, path).select(*PATH)
    made = walkthrough(seen, anchors, path) if mode == "walkthrough" else object_centric(seen, anchors, path)
    kept = frames.join(own.join(anchors.select("clip").distinct(), "clip", "left_anti"), "clip")
    if mode == "object_centric":
        kept = near_orbit(kept, views, path, turned=False)
    return made.select(*PATH).unionByName(kept.select(*PATH))

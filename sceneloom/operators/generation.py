"""Synthetic clips: specs, styles and scenes, all functions of seeds and keys."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.operators.grouped import map_groups

#: Families of layouts: two walls, raised slabs, four walls, a ring of rails, blocks on the ground.
FAMILIES = ("corridor", "platform", "room", "track", "yard")
#: Motion types and how often a profile uses them.
MOTIONS = (("static", 0.3), ("trajectory", 0.15), ("prismatic", 0.1), ("revolute", 0.1), ("periodic_translate", 0.1), ("periodic_rotate", 0.1), ("spin", 0.1), ("dynamic", 0.05))
PALETTE = ("wood", "metal", "plastic", "fabric", "glass", "stone")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 32 bits of the SHA-256 of the parts."""
    key = F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def seed(*parts: Column | str | int) -> Column:
    """A 31-bit seed from the same hash."""
    return F.floor(uniform(*parts) * F.lit(2147483648.0)).cast("long")


def expand_specs(clips: DataFrame, number: str, split: str, variants: int) -> DataFrame:
    """Clip specs of ``clips(number)``: three independent seeds, family in turn; the first ``variants`` get a style and a behaviour
    variant that change exactly one seed."""
    n = F.col(number)
    family = F.array(*[F.lit(f) for f in FAMILIES])[(n % len(FAMILIES)).cast("int")]
    base = clips.select(n.alias("number"), F.concat(F.lit(f"{split}_"), F.format_string("%06d", n)).alias("clip"), family.alias("family"), *[seed(split, n, k).alias(f"{k}_seed") for k in ("behavior", "style", "camera")])
    base = base.withColumn("kind", F.lit("base"))
    first = base.where(F.col("number") < variants)
    style = first.withColumns({"kind": F.lit("style"), "style_seed": seed(split, F.col("number"), "style", 1), "clip": F.concat("clip", F.lit("_s"))})
    behave = first.withColumns({"kind": F.lit("behavior"), "behavior_seed": seed(split, F.col("number"), "behavior", 1), "clip": F.concat("clip", F.lit("_b"))})
    return base.unionByName(style).unionByName(behave)


def generate_style(nodes: DataFrame, style_seed: str, node: str, structure: Column) -> DataFrame:
    """Material and colour of each node from (style seed, node) alone, so the number of nodes cannot leak; structures are muted."""
    u = lambda k: uniform(F.col(style_seed), F.col(node), k)
    material = F.array(*[F.lit(m) for m in PALETTE])[F.floor(u("material") * len(PALETTE)).cast("int")]
    sat = F.when(structure, 0.15).otherwise(0.7)
    channel = lambda k: F.lpad(F.lower(F.hex(F.floor(255 * (0.5 + sat * (u(k) - 0.5)) + 0.5).cast("long"))), 2, "0")
    return nodes.withColumn("material", material).withColumn("base_color", F.concat(F.lit("#"), channel("r"), channel("g"), channel("b")))


def generate_layout(specs: DataFrame) -> DataFrame:
    """Ground and structures of each spec, by its family: ``clip, family, node_id, class, px.., ex..``.

    ``specs(clip, family, behavior_seed, camera_seed)``. The stage's width and depth come from the camera's seed alone, so a new behaviour
    keeps the view; what stands on it comes from the behaviour's seed. The ground's top is at height 0; rails divide their ring evenly by
    their own number. A family without structures of its own has the ground only.
    """
    stage = lambda k, lo, hi: F.round(F.lit(lo) + F.lit(hi - lo) * uniform(F.col("camera_seed"), "stage", k), 2)
    u = lambda *k: uniform(F.col("behavior_seed"), "layout", *k)
    between = lambda lo, hi, *k: F.round(lo + (hi - lo) * u(*k), 2)
    num = lambda x: x if isinstance(x, Column) else F.lit(float(x))

    def part(name, cls: str, pos: tuple, ext: tuple) -> Column:
        values = [num(x).alias(c) for c, x in zip(("px", "py", "pz", "ex", "ey", "ez"), (*pos, *ext))]
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("node_id"), F.lit(cls).alias("class"), *values)

    def numbered(cls: str, least: int, most: int, one) -> Column:
        count = F.lit(least) + F.floor(u("count") * (most - least + 1)).cast("int")
        return F.transform(F.sequence(F.lit(1), count), lambda i: part(F.concat(F.lit(f"{cls}_"), i.cast("string")), cls, *one(i, count)))

    family = F.col("family")
    sizes = {"corridor": ((4.0, 7.0), (18.0, 30.0)), "track": ((16.0, 26.0), (16.0, 26.0))}
    side = lambda axis: F.when(family == "corridor", stage(axis, *sizes["corridor"][axis == "depth"])).when(family == "track", stage(axis, *sizes["track"][axis == "depth"])).otherwise(stage(axis, 10.0, 22.0))
    rows = specs.select("clip", "family", "behavior_seed", "camera_seed", side("width").alias("w"), side("depth").alias("d"))
    w, d = F.col("w"), F.col("d")
    tall = F.when(family == "room", between(F.lit(2.6), F.lit(4.2), "height")).otherwise(between(F.lit(2.4), F.lit(3.6), "height"))
    rows = rows.withColumn("h", tall)
    h = F.col("h")

    def slab(i, _):
        return ((between(-w / 3, w / 3, "px", i), between(F.lit(0.8), F.lit(3.0), "py", i), between(-d / 3, d / 3, "pz", i)),
                (between(F.lit(2.0), F.lit(4.5), "ex", i), between(F.lit(0.3), F.lit(0.6), "ey", i), between(F.lit(2.0), F.lit(4.5), "ez", i)))

    def rail(i, count):
        angle, radius = F.lit(2 * math.pi) * (i - 1) / count, F.least(w, d) / 2 - 1.5
        return (radius * F.cos(angle), 0.125, radius * F.sin(angle)), (1.6, 0.25, 0.5)

    def block(i, _):
        ey = between(F.lit(1.0), F.lit(2.6), "ey", i)
        return ((between(-w / 3, w / 3, "px", i), ey / 2, between(-d / 3, d / 3, "pz", i)), (between(F.lit(1.5), F.lit(3.5), "ex", i), ey, between(F.lit(1.5), F.lit(3.5), "ez", i)))

    across = [part("wall_n", "wall", (0, h / 2, -d / 2), (w, h, 0.3)), part("wall_s", "wall", (0, h / 2, d / 2), (w, h, 0.3))]
    along = [part("wall_w", "wall", (-w / 2, h / 2, 0), (0.3, h, d)), part("wall_e", "wall", (w / 2, h / 2, 0), (0.3, h, d))]
    ground = F.array(part("ground", "ground", (0, -0.2, 0), (w, 0.4, d)))
    more = (
        F.when(family == "room", F.array(*across, *along)).when(family == "corridor", F.array(*along)).when(family == "platform", numbered("platform", 2, 4, slab))
        .when(family == "track", numbered("rail", 6, 10, rail)).when(family == "yard", numbered("block", 1, 3, block)).otherwise(F.filter(ground, lambda _: F.lit(False)))
    )
    return rows.select("clip", "family", F.explode(F.concat(ground, more)).alias("s")).select("clip", "family", "s.*")


def generate_in_layout(specs: DataFrame, objects: int = 5) -> DataFrame:
    """Objects of each spec inside its own layout: off the walls by a margin of the stage's size, clear of slabs, rails and blocks."""
    built = generate_layout(specs)
    stands = F.collect_list(F.when(~F.col("class").isin("ground", "wall"), F.struct("px", "pz", (F.sqrt(F.expr("ex * ex + ez * ez")) / 2).alias("reach"), "node_id")))
    margin = lambda c: F.max(F.when(F.col("class") == "ground", F.col(c) / 2 - F.least(F.lit(1.5), F.col(c) * 0.15)))
    stages = built.groupBy("clip").agg(F.array_sort(stands).alias("blocked"), margin("ex").alias("half_w"), margin("ez").alias("half_d"))
    return _placed(specs.join(stages, "clip"), objects)


def generate_scenes(specs: DataFrame, objects: int = 5, bounds: float = 4.0) -> DataFrame:
    """Objects of each spec on an empty square stage of ``bounds`` to each side: place, size, motion."""
    nothing = F.array().cast("array<struct<px:double,pz:double,reach:double,node_id:string>>")
    return _placed(specs.withColumns({"blocked": nothing, "half_w": F.lit(float(bounds)), "half_d": F.lit(float(bounds))}), objects)


def _placed(specs: DataFrame, objects: int) -> DataFrame:
    """Objects of ``specs(clip, family, behavior_seed, blocked, half_w, half_d)``; the same spec gives the same rows, whatever else is generated.

    Objects keep clear of each other and of what stands there (24 tries each), stay inside the bounds with their motion, move farther
    than their own size, and only visibly asymmetric boxes rotate.
    """
    def one(key, rows):
        for r in rows:
            rnd = random.Random(int.from_bytes(hashlib.sha256(f"{r['family']}/{r['behavior_seed']}".encode()).digest()[:8], "big"))
            placed: list[tuple[float, float, float]] = [(b["px"], b["pz"], b["reach"]) for b in r["blocked"]]
            half_w, half_d = r["half_w"], r["half_d"]
            for i in range(objects):
                for _ in range(24):
                    size = [round(rnd.uniform(0.1, 0.8), 3) for _ in range(3)]
                    reach = math.hypot(size[0], size[2]) / 2
                    x, z = rnd.uniform(-half_w + reach, half_w - reach), rnd.uniform(-half_d + reach, half_d - reach)
                    if all(math.hypot(x - a, z - b) > reach + c for a, b, c in placed):
                        break
                else:
                    continue
                placed.append((x, z, reach))
                motion = rnd.choices([m for m, _ in MOTIONS], [w for _, w in MOTIONS])[0]
                if motion in ("spin", "periodic_rotate", "revolute") and max(size[0], size[2]) < 1.5 * min(size[0], size[2]):
                    motion = "static"
                amp = 0.0
                if motion in ("trajectory", "prismatic", "periodic_translate"):
                    amp = min(max(size) * rnd.uniform(1.1, 2.0), half_w - abs(x))
                    if amp <= max(size):
                        motion, amp = "static", 0.0
                yield r["clip"], i, motion, round(x, 3), size[1] / 2, round(z, 3), size[0], size[1], size[2], round(amp, 3), round(rnd.uniform(0.8, 4.0), 3)

    rows = specs.withColumn("__d", F.pmod(F.xxhash64("clip"), F.lit(1 << 20)))
    schema = "clip string, node int, motion string, px double, py double, pz double, ex double, ey double, ez double, amp double, period double"
    return map_groups(rows, ["__d"], ["clip", "family", "behavior_seed", "blocked", "half_w", "half_d"], one, schema).drop("__d")


def style_pairs(documents: DataFrame, ident: str, content: str, seeds: list[int]) -> DataFrame:
    """Variants of verified documents, one per distinct seed: only style changes; lineage by hashes."""
    s = sorted(set(seeds))
    v = documents.withColumn("style_seed", F.explode(F.array(*[F.lit(x) for x in s])))
    lineage = F.sha2(F.concat_ws("/", F.sha2(F.col(content).cast("binary"), 256), F.col("style_seed").cast("string")).cast("binary"), 256)
    return v.select(F.col(ident).alias("base"), F.concat(F.col(ident).cast("string"), F.lit("_s"), F.col("style_seed").cast("string")).alias("variant"), F.sha2(F.col(content).cast("binary"), 256).alias("source_sha256"), lineage.alias("lineage_sha256"))


def materialise_states(nodes: DataFrame, duration: float, fps: float) -> DataFrame:
    """Positions on a time grid as a pure function of t: ``nodes(clip, node, motion, px, py, pz, amp, period)``.

    prismatic goes along x at constant speed, periodic_translate swings, revolute and spin turn (angle in degrees), trajectory goes
    there and back; dynamic and static stay.
    """
    steps = int(math.floor(duration * fps + 0.5))
    rows = nodes.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("t", F.col("frame") / F.lit(float(fps)))
    part = F.col("t") / F.lit(float(duration))
    swing = F.col("amp") * F.sin(F.lit(2 * math.pi) * F.col("t") / F.col("period"))
    m = F.col("motion")
    dx = F.when(m == "prismatic", F.col("amp") * part).when(m == "periodic_translate", swing).when(m == "trajectory", F.col("amp") * (1 - F.abs(2 * part - 1))).otherwise(0.0)
    angle = F.when(m == "spin", 360 * F.col("t") / F.col("period")).when(m == "periodic_rotate", 30 * F.sin(F.lit(2 * math.pi) * F.col("t") / F.col("period"))).when(m == "revolute", 90 * part).otherwise(0.0)
    return rows.select("clip", "node", "frame", "t", (F.col("px") + dx).alias("px"), "py", "pz", angle.alias("angle_deg"))


def repair(nodes: DataFrame, unit_tolerance: float = 0.02, snap: float = 0.12) -> DataFrame:
    """Proposed repairs: quaternions that are nearly unit are normalised, then small gaps to a known support are closed.

    ``nodes(clip, node, qx.., py, ey, support_top, agrees)``; a snap needs evidence that agrees. What is too far off stays and is named.
    """
    norm = F.sqrt(F.expr("qx * qx + qy * qy + qz * qz + qw * qw"))
    off = F.abs(norm - 1)
    gap = F.col("py") - F.col("ey") / 2 - F.col("support_top")
    q = F.when(off <= 1e-3, "unit").when((off <= unit_tolerance) & (norm > 0), "normalised").otherwise("unresolved")
    s = F.when(gap.isNull(), "no_support").when(F.abs(gap) <= 0.05, "resting").when((F.abs(gap) <= snap) & F.col("agrees"), "snapped").when(F.abs(gap) <= snap, "no_evidence").otherwise("too_far")
    out = nodes.withColumn("quaternion", q).withColumn("support", s)
    fixed = {c: F.when(F.col("quaternion") == "normalised", F.col(c) / norm).otherwise(F.col(c)) for c in ("qx", "qy", "qz", "qw")}
    return out.withColumns({**fixed, "py": F.when(F.col("support") == "snapped", F.col("py") - gap).otherwise(F.col("py"))})

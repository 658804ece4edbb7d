"""Rules over scene nodes: routing, cleaning, roles, de-duplication.

Nodes have clip, node (ordinal), class, grp (static or object), px..pz (centre) and ex..ez (extent).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.components import connected_components
from sceneloom.functions.columns import GROUND_CLASSES, is_ground, is_rigid_structure, is_static
from sceneloom.operators.grouped import map_groups
from sceneloom.shared import stored

LENGTHS = ("px", "py", "pz", "ex", "ey", "ez")
#: Fixed values of the role rules: a player's size, slope and reach.
PLATFORM_TOP_M2, COLLECTIBLE_M, CHUNKINESS, REACH_M, MAX_SLOPE_DEG = 0.45, 1.4, 0.3, 2.7, 55.0
HAZARDS = ("lava", "spike", "water", "fire", "acid", "熔岩", "尖刺", "岩浆")


def route_structure(name: Column, mask_area: Column, motion_type: Column, moves: Column) -> Column:
    """Whether an evidence object is part of the structure.

    A huge mask or a ground class always is. A static class is, unless it is seen to move; for rigid structure
    only a typed motion counts, for the rest the bare flag does too.
    """
    typed = motion_type.isNotNull() & ~motion_type.isin("static", "unknown")
    proof = F.when(is_rigid_structure(name), typed).otherwise(typed | F.coalesce(moves, F.lit(False)))
    return (F.coalesce(mask_area, F.lit(0.0)) >= 0.35) | is_ground(name) | (is_static(name) & ~proof)


def scale_nodes(nodes: DataFrame, factors: DataFrame, keys: list[str], factor: str = "k") -> DataFrame:
    """Length-valued fields times a factor per clip; clips without one keep theirs."""
    k = F.coalesce(F.col(factor), F.lit(1.0))
    joined = nodes.join(factors, keys, "left")
    return joined.withColumns({c: F.col(c) * k for c in LENGTHS}).withColumn("stage_scale", k).drop(factor)


def scale_program(nodes: DataFrame, factors: DataFrame, keys: list[str], factor: str = "k") -> DataFrame:
    """Every length of a program times its clip's factor: poses, extents, radii, heights, instances, key frames, camera, goal, and the
    limits of slides; limits of hinges, angles, times and masses stay. Only the columns that are there are scaled."""
    k = F.coalesce(F.col(factor), F.lit(1.0))
    here = set(nodes.columns)
    point = lambda p: F.transform(p, lambda x: x * k)
    changes = {c: F.col(c) * k for c in (*LENGTHS, "radius", "radius_top", "radius_bottom", "height") if c in here}
    changes |= {c: point(F.col(c)) for c in ("extent", "size", "camera", "goal") if c in here}
    for c in ("keyframes", "instances"):
        if c in here:
            changes[c] = F.transform(c, lambda x: x.withField("pos", point(x["pos"])))
    if "limits" in here:
        changes["limits"] = F.when(F.col("joint") == "slide", point(F.col("limits"))).otherwise(F.col("limits"))
    return nodes.join(factors, keys, "left").withColumns(changes).withColumn("stage_scale", k).drop(factor)


def differing(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, counted with repeats; empty if the halves are equal."""
    return a.select(columns).exceptAll(b.select(columns)).unionAll(b.select(columns).exceptAll(a.select(columns)))


def ground_top(nodes: DataFrame) -> DataFrame:
    """Highest top of the clip's ground nodes."""
    ground = nodes.where((F.col("grp") == "static") & F.lower("class").isin(*GROUND_CLASSES))
    return ground.groupBy("clip").agg(F.max(F.expr("py + ey / 2")).alias("ground_top"))


def settle_on_ground(nodes: DataFrame, tops: DataFrame, tolerance: float = 0.01, most: float = 2.0) -> DataFrame:
    """Lift objects that sink into the ground by up to ``most``; larger lifts are recorded, not made."""
    lift = F.col("ground_top") - (F.col("py") - F.col("ey") / 2)
    sunk = (F.col("grp") == "object") & (lift > tolerance)
    out = nodes.join(tops, "clip", "left").withColumn("lift", F.when(sunk, lift)).withColumn("lifted", F.when(sunk, lift <= most))
    return out.withColumn("py", F.when(F.col("lifted"), F.col("py") + F.col("lift")).otherwise(F.col("py"))).drop("ground_top")


def drop_sunk(nodes: DataFrame, mult: float = 2.0) -> DataFrame:
    """Drop objects whose bottom is still ``mult`` heights below zero. Only right after settling."""
    deep = (F.col("grp") == "object") & (F.col("ey") > 1e-6) & (F.col("py") - F.col("ey") / 2 < -mult * F.col("ey"))
    return nodes.where(~F.coalesce(deep, F.lit(False)))


def apply_settled(nodes: DataFrame, report: DataFrame, keys: list[str], least: float = 0.01, most: float = 0.8) -> DataFrame:
    """Take a simulated resting place if it moved a node a little; say why if it moved it too far."""
    moved = F.sqrt(F.pow(F.col("sx") - F.col("px"), 2) + F.pow(F.col("sy") - F.col("py"), 2) + F.pow(F.col("sz") - F.col("pz"), 2))
    out = nodes.join(report, keys, "left").withColumn("moved", moved)
    take = F.col("moved").between(least, most)
    out = out.withColumn("settled", F.coalesce(take, F.lit(False))).withColumn("reason", F.when(F.col("moved") > most, "shift_exceeds_limit"))
    return out.withColumns({c: F.when(F.col("settled"), F.col(s)).otherwise(F.col(c)) for c, s in (("px", "sx"), ("py", "sy"), ("pz", "sz"))}).drop("sx", "sy", "sz")


def _vertical() -> list[Column]:
    """How far each local axis points up or down, from the quaternion: absolute second row of its rotation."""
    return [F.abs(F.expr("2 * (qx * qy + qw * qz)")), F.abs(F.expr("1 - 2 * (qx * qx + qz * qz)")), F.abs(F.expr("2 * (qy * qz - qw * qx)"))]


def affordance(nodes: DataFrame, ground: DataFrame, moving: Column) -> DataFrame:
    """Role of each node: first rule that fits, hazards before platforms before the rest.

    A node may have several rows, one per instance: the most lenient instance decides. With ``qx, qy, qz, qw`` boxes are turned
    first: a face carries a player if its footprint is large enough and it is not too steep; without them boxes stand upright.
    """
    up = _vertical() if "qx" in nodes.columns else [F.lit(0.0), F.lit(1.0), F.lit(0.0)]
    edges = ("ex", "ey", "ez")
    stand = F.lit(False)
    for k in range(3):
        i, j = (c for c in range(3) if c != k)
        stand = stand | ((F.col(edges[i]) * F.col(edges[j]) * up[k] >= PLATFORM_TOP_M2) & (up[k] >= math.cos(math.radians(MAX_SLOPE_DEG))))
    rows = nodes.join(ground, "clip", "left").withColumns({"__m": moving, "__stand": stand, "__high": F.col("py") - F.coalesce("level", F.lit(0.0))})
    one = rows.groupBy("clip", "node").agg(
        *[F.first(c).alias(c) for c in ("class", "grp", *edges)], F.bool_or("__m").alias("__m"), F.bool_or("__stand").alias("__stand"), F.min("__high").alias("__high")
    )
    hazard = F.lower(F.coalesce("class", F.lit(""))).rlike("|".join(HAZARDS))
    sizes = F.reverse(F.array_sort(F.array(*edges)))
    small = (sizes[0] <= COLLECTIBLE_M) & (sizes[1] / F.greatest(sizes[0], F.lit(1e-6)) >= CHUNKINESS)
    reach = F.col("__high") <= REACH_M
    role = (
        F.when(hazard, "hazard").when(F.col("grp") == "static", "static_structure").when(F.least(*edges) <= 0, "decoration")
        .when(F.col("__stand") & F.col("__m"), "dynamic_platform").when(F.col("__stand"), "platform").when(small & reach, "collectible")
        .when(F.col("__m") & reach, "moving_obstacle").otherwise("decoration")
    )
    return one.withColumn("role", role).drop("__m", "__stand", "__high")


def binding_slots(roles: DataFrame) -> DataFrame:
    """Per clip the nodes of each slot that a game binding asks for."""
    pick = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("node"))))
    return roles.groupBy("clip").agg(pick("collectible").alias("collectibles"), pick("hazard").alias("hazards"), pick("dynamic_platform").alias("dynamic_platforms"), pick("moving_obstacle").alias("moving_obstacles"))


def footprint_factor(nodes: DataFrame, target: float = 24.0, dead_band: float = 0.05) -> DataFrame:
    """Factor per clip that brings its horizontal footprint to the target; none if it is within the dead band."""
    side = lambda c: F.max(F.expr(f"p{c} + e{c} / 2")) - F.min(F.expr(f"p{c} - e{c} / 2"))
    size = nodes.groupBy("clip").agg(F.greatest(side("x"), side("z")).alias("footprint")).where("footprint > 0")
    k = F.lit(target) / F.col("footprint")
    return size.withColumn("k", F.when(F.abs(k - 1) <= dead_band, 1.0).otherwise(k))


def ground_level(nodes: DataFrame) -> DataFrame:
    """Top of the static node with the largest footprint, the clip's standing level."""
    area = F.greatest(F.expr("ex * ez"), F.lit(0.0))
    return nodes.where("grp = 'static'").groupBy("clip").agg(F.max_by(F.expr("py + ey / 2"), F.struct(area, -F.col("node"))).alias("level"))


def merge_duplicates(nodes: DataFrame, most: float = 0.5) -> DataFrame:
    """Objects with ``kept_as``: null if kept, else the kept node they repeat, and the relative distance.

    In each clip and class nodes are visited by support (frames, then confidence, then ordinal); a node near one
    already kept is dropped. The rule is sequential, so a small helper runs it per clip and class on compact rows.
    """
    def visit(_, group):
        kept: list[tuple] = []
        for r in group:
            at, diag = (r["px"], r["py"], r["pz"]), math.sqrt(r["ex"] ** 2 + r["ey"] ** 2 + r["ez"] ** 2)
            into = relative = None
            for node, other, size in kept if diag > 1e-6 else ():
                if size > 1e-6 and math.dist(at, other) / ((diag + size) / 2) <= most:
                    into, relative = node, round(math.dist(at, other) / ((diag + size) / 2), 3)
                    break
            else:
                kept.append((r["node"], at, diag))
            yield r["node"], into, relative

    rows = nodes.withColumns({"class": F.lower("class"), "__f": -F.col("frames"), "__c": -F.col("confidence")})
    return map_groups(rows, ["clip", "class"], ["__f", "__c", "node", "px", "py", "pz", "ex", "ey", "ez"], visit, "node long, kept_as long, relative_distance double").drop("class")


def _neighbours(least: tuple[int, int, int] | None = None) -> Column:
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if least is None or (x, y, z) > least]
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in steps])


def _near_pairs(nodes: DataFrame, reach: float) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of one clip whose gap is at most ``reach`` mean diagonals, from ``nodes(id, clip, px, py, pz, diag)``.

    Every node lies in a grid for its size (a power of two), and in those of the larger sizes that its clip has; a pair meets in the
    grid of the larger node. So one huge node makes no other pairs, and clips do not know of each other's sizes.
    """
    size = lambda level: F.lit(reach) * F.pow(F.lit(2.0), F.col(level))
    cell = lambda level, step=None: [
        (F.floor(F.col(f"p{c}") / size(level)).cast("long") + (F.col(f"{step}.{c}") if step else F.lit(0))).alias(f"c{c}") for c in "xyz"
    ]
    d = stored(nodes.withColumn("level", F.ceil(F.log2(F.greatest("diag", F.lit(1e-6)))).cast("int")), "sized-nodes")
    own = [F.col(c) for c in ("clip", "id", "level", "px", "py", "pz", "diag")]
    a = d.withColumn("__o", F.explode(_neighbours())).select(*own, *cell("level", "__o"))
    grids = d.select(F.col("clip").alias("__clip"), F.col("level").alias("grid")).distinct()
    b = d.join(grids, F.col("clip").eqNullSafe(F.col("__clip")) & (F.col("grid") >= F.col("level"))).select(
        F.col("clip").alias("__clip"), F.col("id").alias("b"), F.col("level").alias("o_level"), *[F.col(c).alias(f"o_{c}") for c in ("px", "py", "pz", "diag")], "grid", *cell("grid"))
    b = b.withColumnsRenamed({c: f"o_{c}" for c in ("cx", "cy", "cz")})
    met = a.join(b, a["clip"].eqNullSafe(b["__clip"]) & (a["level"] == b["grid"]) & (a["cx"] == b["o_cx"]) & (a["cy"] == b["o_cy"]) & (a["cz"] == b["o_cz"]))
    met = met.where("level > o_level OR (level = o_level AND id < b)")
    gap = F.sqrt(F.expr("pow(px - o_px, 2) + pow(py - o_py, 2) + pow(pz - o_pz, 2)"))
    return met.where(gap <= reach * (F.col("diag") + F.col("o_diag")) / 2).select(F.col("id").alias("a"), "b")


def fragment_chains(nodes: DataFrame, reach: float = 2.5, elongation: float = 3.0, small: int = 64) -> DataFrame:
    """Groups of nodes linked by gaps of at most ``reach`` mean diagonals whose common box is elongated.

    One row per group: clip, component (its least node), members, and the box. Clips and nodes may be of any type that has an order.
    A clip of up to ``small`` nodes is grouped where its rows are, pair by pair; rows of larger clips pass in pieces of that size, are numbered
    and meet in grids.
    """
    box = ("px", "py", "pz", "ex", "ey", "ez")
    own = Window.partitionBy("clip")
    sized = nodes.select("clip", "node", *[F.col(c).cast("double").alias(c) for c in box], F.sqrt(F.expr("ex * ex + ey * ey + ez * ez")).alias("diag"), F.count(F.lit(1)).over(own).alias("__n"), F.row_number().over(own.orderBy("node", *box)).alias("__at"))
    sized = sized.where("__n > 1").withColumn("__piece", F.when(F.col("clip").isNotNull() & (F.col("__n") <= small), F.lit(0)).otherwise(1 + F.floor((F.col("__at") - 1) / small).cast("int")))

    def group(key, rows):
        if key[1] > 0:
            for r in rows:
                yield r["node"], None, r["diag"], *(r[c] for c in box)
            return
        rows = [r for r in rows if r["diag"] is not None and None not in (r["px"], r["py"], r["pz"])]
        head = list(range(len(rows)))

        def top(i):
            while head[i] != i:
                head[i] = i = head[head[i]]
            return i

        for i, p in enumerate(rows):
            for j in range(i):
                q = rows[j]
                x, y, z = (p[c] - q[c] for c in ("px", "py", "pz"))
                if math.sqrt(x * x + y * y + z * z) <= reach * (p["diag"] + q["diag"]) / 2:
                    one, two = sorted((top(i), top(j)))
                    head[two] = one
        found: dict[int, list[dict]] = {}
        for i, p in enumerate(rows):
            found.setdefault(top(i), []).append(p)
        for members in found.values():
            if len(members) > 1:
                sides = [max(m[f"p{a}"] + m[f"e{a}"] / 2 for m in members) - min(m[f"p{a}"] - m[f"e{a}"] / 2 for m in members) for a in "xyz"]
                yield min(m["node"] for m in members), len(members), None, *sides, None, None, None

    kind = nodes.schema["node"].dataType.simpleString()
    out = stored(map_groups(sized, ["clip", "__piece"], ["node", *box, "diag"], group, f"node {kind}, members long, diag double, " + ", ".join(f"{c} double" for c in box)), "chains")
    done = out.where("members IS NOT NULL").select("clip", F.col("node").alias("component"), "members", F.col("px").alias("bx"), F.col("py").alias("by"), F.col("pz").alias("bz"))
    rest = out.where("members IS NULL")
    if not rest.isEmpty():
        d = stored(rest.select("clip", "node", *box, "diag", F.monotonically_increasing_id().alias("id")), "numbered-nodes")
        labels = connected_components(_near_pairs(d, reach))
        rows = d.join(labels.select(F.col("node").alias("id"), F.col("component").alias("__group")), "id")
        done = done.unionByName(rows.groupBy("clip", "__group").agg(
            F.min("node").alias("component"), F.count(F.lit(1)).alias("members"),
            *[(F.max(F.expr(f"p{a} + e{a} / 2")) - F.min(F.expr(f"p{a} - e{a} / 2"))).alias(f"b{a}") for a in "xyz"],
        ).drop("__group"))
    edges = F.reverse(F.array_sort(F.array("bx", "by", "bz")))
    return done.where((F.col("members") >= 2) & (edges[0] >= elongation * edges[1]))


def _local_clusters(code: np.ndarray, width: int) -> np.ndarray:
    """The least code of those that a cell of a cube reaches over neighbours; ``code`` = (x * width + y) * width + z, each once, in order."""
    wide = width + 2  # a rim of empty cells
    at = ((code // width**2 + 1) * wide + code // width % width + 1) * wide + code % width + 1
    place = np.full(wide**3, -1, dtype=np.int32)
    place[at] = np.arange(len(at))
    pairs = []
    for x, y, z in ((x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)):
        other = place[at + (x * wide + y) * wide + z]
        pairs.append(np.stack([np.flatnonzero(other >= 0), other[other >= 0]]))
    a, b = np.concatenate(pairs, axis=1)
    label = np.arange(len(at))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return code[label]


def voxel_clusters(points: DataFrame, keys: list[str], link: float, least: int = 20, width: int = 32) -> DataFrame:
    """Clusters of points whose cells of size ``link`` touch (26 neighbours): keys, component, points, cells, centroid.

    Points never meet in pairs. Cells are joined inside cubes of ``width`` cells to a side first; of a cube only its clusters and the cells on its
    sides leave, and only clusters that touch across sides are joined. ``component`` is a number within the result; clusters are
    numbered, not hashed, so different ones never share one.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    cube = ["bx", "by", "bz"]
    cell = {c: F.floor(F.col(p) / link).cast("long") for c, p in (("cx", "x"), ("cy", "y"), ("cz", "z"))}
    rows = points.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "x", "y", "z", *[c.alias(n) for n, c in cell.items()])
    inside = sum((F.pmod(F.col(f"c{c}"), F.lit(width)) * width**i for i, c in enumerate("zyx")), F.lit(0).cast("long"))
    rows = rows.withColumns({f"b{c}": F.floor(F.col(f"c{c}") / width).cast("long") for c in "xyz"} | {"code": inside})
    # A cell without a place has no neighbours; its parts of a place tell it from others.
    parts = [F.when(F.col("code").isNull(), F.col(c)).alias(f"__{c}") for c in cell]
    cells = rows.groupBy(*names, *cube, "code", *parts).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"])

    def cluster(key, m):
        code, sums = m[:, 0], m[:, 1:]
        label = np.arange(len(m), dtype=np.int64)
        placed = not np.isnan(code).any() and None not in key
        if placed:
            code = code.astype(np.int64)
            label = np.searchsorted(code, _local_clusters(code, width))
        at, which = np.unique(label, return_inverse=True)
        total = [[None if np.isnan(x) else float(x) for x in np.bincount(which, s)] for s in sums.T]
        for first, cells, n, *xyz in zip(at, np.bincount(which), *total):
            yield int(code[first]) if placed else None, None, int(n), int(cells), *xyz
        if placed:
            for side in np.flatnonzero(np.any([(code // width**k % width == 0) | (code // width**k % width == width - 1) for k in range(3)], axis=0)):
                yield int(code[label[side]]), int(code[side]), None, None, None, None, None

    found = map_groups(cells, [*names, *cube], ["code", "n", "sx", "sy", "sz"], cluster, "label long, side long, n long, cells long, sx double, sy double, sz double", numbers=True)
    found = stored(found.withColumn("id", F.monotonically_increasing_id()), "clusters")
    sides, clusters = found.where("side IS NOT NULL"), found.where("side IS NULL").drop("side")
    place = lambda c, i: (F.col(f"b{c}") * width + F.floor(F.col("side") / width**i) % width).alias(f"c{c}")
    sides = sides.select(*names, *cube, "label", *[place(c, i) for i, c in enumerate("zyx")])
    several = clusters.select(*names, *cube).distinct().groupBy(*names).agg(F.count(F.lit(1)).alias("__cubes")).where("__cubes > 1").select(*names)
    sides = stored(sides.join(several, names, "left_semi"), "sides")
    labelled = clusters.withColumn("component", F.col("id"))
    if not sides.isEmpty():
        out = sides.withColumn("__o", F.explode(_neighbours((0, 0, 0)))).select(
            *names, *[F.col(c).alias(f"o{c}") for c in cube], F.col("label").alias("o_label"), *[(F.col(f"c{c}") + F.col(f"__o.{c}")).alias(f"c{c}") for c in "xyz"])
        met = sides.join(out, [*names, "cx", "cy", "cz"]).where("bx <> obx OR by <> oby OR bz <> obz")
        met = met.select(*names, *cube, "label", *[f"o{c}" for c in cube], "o_label").distinct()
        ids = clusters.where("label IS NOT NULL").select(*names, *cube, "label", "id")
        links = met.join(ids.withColumnRenamed("id", "a"), [*names, *cube, "label"])
        links = links.join(ids.select(*names, *[F.col(c).alias(f"o{c}") for c in cube], F.col("label").alias("o_label"), F.col("id").alias("b")), [*names, *[f"o{c}" for c in cube], "o_label"]).select("a", "b")
        labels = connected_components(links).select(F.col("node").alias("id"), "component")
        labelled = clusters.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = labelled.groupBy(*names, "component").agg(F.sum("n").alias("points"), F.sum("cells").alias("cells"), *[(F.sum(f"s{c}") / F.sum("n")).alias(c) for c in "xyz"])
    return out.where(F.col("points") >= least).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "component", "points", "cells", "x", "y", "z")


def size_outliers(sized: DataFrame, keys: list[str], size: str, ratio: float = 3.0, peers: int = 3) -> DataFrame:
    """Rows whose size is ``ratio`` times off the median of their group of at least ``peers``."""
    medians = sized.groupBy(*keys).agg(F.percentile(size, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("peers"))
    out = sized.join(medians, keys).where((F.col("peers") >= peers) & (F.col("median") > 0)).withColumn("ratio", F.col(size) / F.col("median"))
    return out.where((F.col("ratio") >= ratio) | (F.col("ratio") <= 1 / ratio))


def snap_label(labels: DataFrame, phrases: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels with the phrase they stand for: itself, the longest phrase in it, the only phrase it is part of, else unchanged.

    Candidates meet by the first word of a phrase, or by the first three characters of a fragment, never all
    with all.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s*##", ""), r"\s+", " "))
    rows = labels.select(label).distinct().withColumn("__l", clean)
    ph = phrases.select(F.lower(F.trim("phrase")).alias("phrase")).distinct().where("phrase <> ''")
    inside = rows.withColumn("__w", F.explode(F.split("__l", " "))).join(ph.withColumn("__w", F.split("phrase", " ")[0]), "__w")
    inside = inside.where(F.concat(F.lit(" "), "__l", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    grams = ph.withColumn("__g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("phrase") - 2, F.lit(1))), lambda i: F.substring("phrase", i, 3)))))
    parts = rows.where(F.length("__l") >= 3).withColumn("__g", F.substring("__l", 1, 3)).join(grams, "__g").where(F.col("phrase").contains(F.col("__l")))
    parts = parts.groupBy(label).agg(F.countDistinct("phrase").alias("__n"), F.min("phrase").alias("phrase")).where("__n = 1")
    found = (
        inside.select(label, "phrase", F.when(F.col("__l") == F.col("phrase"), 0).otherwise(1).alias("__rule")).unionByName(parts.select(label, "phrase", F.lit(2).alias("__rule")))
    )
    best = F.row_number().over(Window.partitionBy(label).orderBy("__rule", F.desc(F.length("phrase")), "phrase"))
    return rows.join(found.withColumn("__r", best).where("__r = 1").select(label, "phrase"), label, "left").select(label, F.coalesce("phrase", label).alias("snapped"))


def evidence_to_nodes(boxes: DataFrame, keys: list[str], t: str, structure: Column, least: float = 0.05) -> DataFrame:
    """One node per object: first box centre, median size (at least ``least``), static or movable."""
    out = boxes.groupBy(*keys).agg(
        *[F.min_by(c, t).alias(c) for c in ("px", "py", "pz")], *[F.greatest(F.percentile(c, F.lit(0.5)), F.lit(least)).alias(c) for c in ("ex", "ey", "ez")],
        F.max(structure).alias("__s"), F.count(F.lit(1)).alias("frames"),
    )
    return out.withColumn("grp", F.when(F.col("__s"), "static").otherwise("object")).drop("__s")


#: Words in a class that make a structure a thin slab, its greatest height, the most of a frame an object covers.
SLAB_WORDS, SLAB_HEIGHT = ("floor", "ground", "lawn", "grass", "carpet", "mat", "road"), 0.3


def flatten_slabs(nodes: DataFrame) -> DataFrame:
    """Static nodes whose class holds a slab word become at most ``SLAB_HEIGHT`` high, their tops at zero; the rest stays."""
    word = F.lit(False)
    for w in SLAB_WORDS:
        word = word | F.contains(F.lower(F.coalesce("class", F.lit(""))), F.lit(w))
    slab = (F.col("grp") == "static") & word
    high = F.least("ey", F.lit(SLAB_HEIGHT))
    return nodes.withColumns({"ey": F.when(slab, high).otherwise(F.col("ey")), "py": F.when(slab, -high / 2).otherwise(F.col("py")), "slab": slab})


def motion_params(track: DataFrame, keys: list[str], t: str, value: str, size: Column, most: int = 12, share: float = 0.4) -> DataFrame:
    """Key frames of each observed trajectory: at most ``most`` evenly indexed samples, if it leaves its place.

    Tracks of three samples or more whose largest displacement is ``share`` of their size or more.
    """
    by = Window.partitionBy(*keys)
    o = by.orderBy(t)
    first = F.first(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = track.withColumn("__d", F.abs(F.col(value) - first)).withColumn("__s", size)
    rows = rows.withColumn("__far", F.max("__d").over(by)).withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__i", F.row_number().over(o) - 1)
    rows = rows.where((F.col("__n") >= 3) & (F.col("__far") >= share * F.col("__s")))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / F.lit(float(most - 1)), 0).cast("long"))
    return rows.where((F.col("__n") <= most) | F.array_contains(picks, F.col("__i").cast("long"))).select(*keys, t, value)


def recamera(clips: DataFrame, views: int, base_seed: int, clip: str = "clip") -> DataFrame:
    """K orbit views of each clip: name, seed (base XOR the first four bytes of the clip's SHA-256), yaw, and a hash uniform."""
    v = clips.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    head = F.conv(F.substring(F.sha2(F.col(clip).cast("string"), 256), 1, 8), 16, 10).cast("long")
    u = F.conv(F.substring(F.sha2(F.concat_ws("/", F.col(clip).cast("string"), F.col("view").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return v.select(
        clip, F.concat(F.col(clip).cast("string"), F.lit("_v"), F.col("view").cast("string")).alias("name"), F.lit(base_seed).cast("long").bitwiseXOR(head).alias("seed"),
        (F.lit(360.0) * F.col("view") / F.lit(float(views))).alias("yaw_deg"), u.alias("uniform"),
    )

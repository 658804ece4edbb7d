"""Rule engines: each rule yields rows of one findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.shared import release, stored

FINDING = ["clip", "stage", "severity", "code", "path"]


def finding(rows: DataFrame, stage: str, severity: str, code: str, path: Column) -> DataFrame:
    return rows.select(F.col("clip"), F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.cast("string").alias("path"))


def row_findings(rows: DataFrame, stage: str, rules: list[tuple[str, str, Column]], path: Column) -> DataFrame:
    """All findings that one row alone decides, in a single pass: (severity, code, broken)."""
    found = F.array(*[F.when(broken, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, broken in rules])
    return rows.select(F.col("clip"), F.lit(stage).alias("stage"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"), path.cast("string").alias("path")).select(
        "clip", "stage", "f.severity", "f.code", "path"
    )


def not_finite(*columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return F.coalesce(bad, F.lit(False))


def validate_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Structure of scene programs: numbers, dimensions, repeated ids, unknown references, support cycles.

    ``nodes(clip, node_id, grp, px.., ex..)``; ``refs(clip, node_id, target)`` are support references.
    """
    local = row_findings(
        nodes, "program",
        [("error", "non_finite", not_finite("px", "py", "pz", "ex", "ey", "ez")), ("error", "bad_dimensions", F.least("ex", "ey", "ez") <= 0),
         ("error", "missing_pose", F.col("px").isNull() | F.col("py").isNull() | F.col("pz").isNull())], F.col("node_id"),
    )
    repeated = finding(nodes.groupBy("clip", "node_id").count().where("count > 1"), "program", "error", "duplicate_id", F.col("node_id"))
    ids = nodes.select("clip", F.col("node_id").alias("target")).distinct()
    unknown = finding(refs.join(ids, ["clip", "target"], "left_anti"), "program", "error", "unknown_reference", F.col("node_id"))
    statics = nodes.groupBy("clip").agg(F.count_if(F.col("grp") == "static").alias("n")).where("n = 0")
    none = finding(statics, "program", "warning", "no_static", F.lit("/static"))
    return local.unionAll(repeated).unionAll(unknown).unionAll(none).unionAll(support_cycles(refs))


def support_cycles(refs: DataFrame, max_doublings: int = 60) -> DataFrame:
    """Nodes whose chain of supports never ends.

    Steps are doubled: after k rounds the nodes that still have a target are those with 2^k steps before them. Once a round
    leaves as many, no chain that ends is that long, and the rest is on or above a cycle. Pairs are kept once, so a node with several
    references does not multiply.
    """
    jumps = stored(refs.where("node_id IS NOT NULL AND target IS NOT NULL").select("clip", "node_id", "target").distinct(), "jumps")
    before = None
    for _ in range(max_doublings):
        now = jumps.agg(F.countDistinct("clip", "node_id")).first()[0]
        if now == before or not now:
            break
        before, old = now, jumps
        nxt = jumps.select("clip", F.col("node_id").alias("target"), F.col("target").alias("__t"))
        jumps = stored(jumps.join(nxt, ["clip", "target"]).select("clip", "node_id", F.col("__t").alias("target")).distinct(), "jumps")
        release(old)
    else:
        raise RuntimeError(f"support chains did not end in 2^{max_doublings} steps")
    return finding(jumps.select("clip", "node_id").distinct(), "program", "error", "support_cycle", F.col("node_id"))


def time_order(rows: DataFrame, keys: list[str], order: list[str], t: str, code: str, strict: bool = True) -> DataFrame:
    """A finding for each row whose time is not after (or, if not strict, before) the one before it."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))
    bad = step <= 0 if strict else step < 0
    return finding(rows.withColumn("__bad", bad).where("__bad"), "time", "error", code, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))


def support_findings(nodes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Ground penetration and support gaps of boxes: each object against the highest static top below its footprint.

    One finding per object: the support is the static node with the highest top that its footprint overlaps.
    """
    o = nodes.where("grp = 'object'").select("clip", "node", *[F.col(c).alias(f"o{c}") for c in ("px", "py", "pz", "ex", "ey", "ez")])
    s = nodes.where("grp = 'static'").select("clip", F.col("node").alias("support"), *[F.col(c).alias(f"s{c}") for c in ("px", "py", "pz", "ex", "ey", "ez")])
    over = (F.abs(F.col("opx") - F.col("spx")) * 2 < F.col("oex") + F.col("sex")) & (F.abs(F.col("opz") - F.col("spz")) * 2 < F.col("oez") + F.col("sez"))
    pairs = o.join(s, "clip").where(over).withColumn("top", F.expr("spy + sey / 2")).withColumn("bottom", F.expr("opy - oey / 2"))
    best = F.row_number().over(Window.partitionBy("clip", "node").orderBy(F.desc("top"), "support"))
    gap = pairs.withColumn("__r", best).where("__r = 1").withColumn("gap", F.col("bottom") - F.col("top"))
    code = F.when(F.col("gap") < -tolerance, "support_penetration").when(F.col("gap") > tolerance, "support_gap")
    return gap.withColumn("code", code).where("code is not null").select("clip", "node", "support", "gap", "code")


def integrity(recorded: DataFrame, declared: DataFrame, expected: DataFrame) -> DataFrame:
    """Frames against the program: missing and extra ids per frame, and clips whose frame count is off.

    ``recorded(clip, frame, id)``, ``declared(clip, id)``, ``expected(clip, frames)``.
    """
    frames = recorded.select("clip", "frame").distinct()
    want = frames.join(declared, "clip")
    missing = want.join(recorded, ["clip", "frame", "id"], "left_anti").groupBy("clip").agg(F.count(F.lit(1)).alias("missing"))
    extra = recorded.join(declared, ["clip", "id"], "left_anti").groupBy("clip").agg(F.count(F.lit(1)).alias("extra"))
    seen = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("frames_seen"))
    out = expected.join(seen, "clip", "left").join(missing, "clip", "left").join(extra, "clip", "left").na.fill(0, ["frames_seen", "missing", "extra"])
    return out.withColumn("ok", (F.col("frames") == F.col("frames_seen")) & (F.col("missing") == 0) & (F.col("extra") == 0))


def expected_frames(duration: Column, fps: Column) -> Column:
    """Frames a recording of this length must have: rounded half up, and the end point unless it is a frame."""
    n = F.floor(duration * fps + 0.5)
    return (n + F.when(F.abs(n / fps - duration) > 1e-9, 1).otherwise(0)).cast("long")


def resolve_truth(runs: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """Exactly one truth by name, else exactly one by alias, else refuse: ambiguous or not found. Never picks.

    ``truths(truth, name, alias)``.
    """
    by_name = truths.groupBy(F.col("name").alias(key)).agg(F.count(F.lit(1)).alias("__n"), F.min("truth").alias("__t"))
    by_alias = truths.groupBy(F.col("alias").alias(key)).agg(F.count(F.lit(1)).alias("__m"), F.min("truth").alias("__u"))
    j = runs.join(by_name, key, "left").join(by_alias, key, "left")
    n, m = F.coalesce("__n", F.lit(0)), F.coalesce("__m", F.lit(0))
    status = F.when(n == 1, "by_name").when(n > 1, "ambiguous").when(m == 1, "by_alias").when(m > 1, "ambiguous").otherwise("not_found")
    return j.withColumn("status", status).withColumn("truth", F.when(n == 1, F.col("__t")).when((n == 0) & (m == 1), F.col("__u"))).drop("__n", "__t", "__m", "__u")


def resolve_by_content(videos: DataFrame, associations: DataFrame) -> DataFrame:
    """Truth of each video by the hash of its content: exactly one confirmed association, else refused with a reason.

    ``videos(video, sha256, window_end, program_sha256)``: the window that is asked for starts at zero, and the hash is the truth's as it is now.
    ``associations(association, video_sha256, status, video_start, program_start, rate, duration, program_sha256)``. Names are no fallback.
    """
    by_hash = associations.groupBy(F.col("video_sha256").alias("sha256")).agg(
        F.count_if(F.col("status") == "confirmed").alias("__confirmed"),
        F.min(F.when(F.col("status") == "confirmed", F.struct("association", "video_start", "program_start", "rate", "duration", F.col("program_sha256").alias("reviewed")))).alias("__a"))
    a = lambda c: F.col(f"__a.{c}")
    reason = (
        F.when(F.coalesce(F.col("window_end"), F.lit(0.0)) <= 0, "unsupported_window").when(F.col("__confirmed").isNull(), "not_found").when(F.col("__confirmed") == 0, "review_required")
        .when(F.col("__confirmed") > 1, "conflict").when((a("video_start") != 0) | (a("program_start") != 0) | (a("rate") != 1), "unsupported_time_mapping")
        .when(F.col("window_end") > a("duration"), "window_out_of_range").when(~F.col("program_sha256").eqNullSafe(a("reviewed")), "program_changed")
    )
    out = videos.join(by_hash, "sha256", "left").withColumn("reason", reason)
    return out.withColumn("association", F.when(F.col("reason").isNull(), a("association"))).drop("__confirmed", "__a")


def validate_evidence(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """Observations of objects: one per frame, known frames, box inside the image, depths in order.

    ``observations(clip, object_id, frame_index, t, x1, y1, x2, y2, width, height, d_min, d_median, d_max)``, ``frames(clip, frame_index, t)``.
    """
    path = F.concat_ws("/", F.col("object_id").cast("string"), F.col("frame_index").cast("string"))
    local = row_findings(
        observations, "evidence",
        [("error", "bbox_outside_image", (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > F.col("width")) | (F.col("y2") > F.col("height")) | (F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1"))),
         ("error", "depth_order", (F.col("d_min") > F.col("d_median")) | (F.col("d_median") > F.col("d_max"))), ("warning", "unknown_depth", F.col("d_median").isNull())], path,
    )
    twice = finding(observations.groupBy("clip", "object_id", "frame_index").count().where("count > 1"), "evidence", "error", "repeated_observation", path)
    lost = finding(observations.join(frames.select("clip", "frame_index").distinct(), ["clip", "frame_index"], "left_anti"), "evidence", "error", "unknown_frame", path)
    known = observations.alias("o").join(frames.select("clip", "frame_index", F.col("t").alias("__t")), ["clip", "frame_index"])
    off = finding(known.where(F.abs(F.col("t") - F.col("__t")) > 1e-4), "evidence", "error", "frame_time_mismatch", path)
    return local.unionAll(twice).unionAll(lost).unionAll(off)


def render_checks(frames: DataFrame, pixels: DataFrame, tolerance: float = 0.005, unknown_most: float = 0.05, visible_px: int = 4) -> DataFrame:
    """Render logs: time order, requested against actual time, too many unknown pixels, objects never seen.

    ``frames(clip, frame, t_requested, t, unknown_px, all_px)``, ``pixels(clip, frame, id, px)``.
    """
    local = row_findings(
        frames, "render", [("error", "time_off", F.abs(F.col("t") - F.col("t_requested")) > tolerance), ("error", "unknown_ids", F.col("unknown_px") > unknown_most * F.col("all_px"))], F.col("frame")
    )
    order = time_order(frames, ["clip"], ["frame"], "t", "time_not_increasing")
    seen = pixels.groupBy("clip", "id").agg(F.max("px").alias("most")).where(F.col("most") < visible_px)
    return local.unionAll(order).unionAll(finding(seen, "render", "warning", "never_visible", F.col("id")))


def flatten_json(spark, rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) of every leaf of JSON documents, paths as JSON pointers; a vectorised helper."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    def leaves(x, path: str):
        if isinstance(x, dict) and x:
            for k in sorted(x):
                yield from leaves(x[k], f"{path}/{k.replace('~', '~0').replace('/', '~1')}")
        elif isinstance(x, list) and x:
            for i, v in enumerate(x):
                yield from leaves(v, f"{path}/{i}")
        else:
            yield path, json.dumps(x)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(k, p, v) for k, text in zip(pdf["k"], pdf["d"]) if text is not None for p, v in leaves(json.loads(text), "")]
            yield pd.DataFrame(out, columns=["key", "path", "value"])

    return rows.select(F.col(key).cast("string").alias("k"), F.col(document).alias("d")).mapInPandas(run, "key string, path string, value string")


def edit_judgement(before: DataFrame, after: DataFrame, wanted: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per key: paths changed, paths where the result is not what was wanted, and whether the edit passes.

    All three are (key, path, value) rows; numbers compare within the tolerance.
    """
    def same(a: str, b: str) -> Column:
        x, y = F.col(a).try_cast("double"), F.col(b).try_cast("double")
        return F.col(a).eqNullSafe(F.col(b)) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))

    def renamed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("value", name)

    j = renamed(before, "b").join(renamed(after, "a"), ["key", "path"], "full").join(renamed(wanted, "w"), ["key", "path"], "full")
    return j.groupBy("key").agg(F.count_if(~same("b", "a")).alias("changed"), F.count_if(~same("a", "w")).alias("wrong")).withColumn("passed", F.col("wrong") == 0)


def geometry_audit(boxes: DataFrame, planes: DataFrame, contacts: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Signed gap of boxes above their clip's plane, and contact claims that a gap inside their interval contradicts.

    ``boxes(clip, object_id, t, py, ey)``, ``planes(clip, offset)`` (up), ``contacts(clip, object_id, t_start, t_end)``.
    """
    gap = boxes.join(planes, "clip").withColumn("gap", F.col("py") - F.col("ey") / 2 + F.col("offset"))
    claims = contacts.select("clip", "object_id", "t_start", "t_end", F.lit(True).alias("__claim"))
    j = gap.join(claims, (gap["clip"] == claims["clip"]) & (gap["object_id"] == claims["object_id"]) & (gap["t"] >= claims["t_start"]) & (gap["t"] <= claims["t_end"]), "left")
    j = j.select(gap["clip"], gap["object_id"], gap["t"], "gap", F.coalesce("__claim", F.lit(False)).alias("claimed"))
    return j.withColumn("below", F.col("gap") < -tolerance).withColumn("contradicted", F.col("claimed") & (F.abs("gap") > tolerance))


def world_box(q: list[Column], extent: list[Column]) -> tuple[list[Column], Column]:
    """Half edges of the axis-parallel box around a turned one, and whether its quaternion (x, y, z, w) can be used."""
    norm = F.sqrt(sum((c * c for c in q), F.lit(0.0)))
    unit = F.when(norm > 1e-12, norm)  # null where there is no direction
    x, y, z, w = (c / unit for c in q)
    rows = [
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    ]
    return [sum((F.abs(r) * e / 2 for r, e in zip(row, extent)), F.lit(0.0)) for row in rows], norm > 1e-12


def geometry_findings(nodes: DataFrame, ground_classes: tuple[str, ...], unit: float = 1e-3, contact: float = 0.05) -> DataFrame:
    """What a scene's own geometry shows: bad quaternions, objects in the ground, objects off, in or above their support.

    ``nodes(clip, node, node_id, grp, class, px.., ex.., qx.., support)``. Boxes are turned by their quaternions. A pose gets one ground
    finding, from the first ground (by ``node``) that it is in; the support is the node it names, whatever lies below.
    """
    q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    norm = F.sqrt(sum((c * c for c in q), F.lit(0.0)))
    bad = not_finite("qx", "qy", "qz", "qw")
    local = row_findings(nodes, "geometry", [
        ("error", "non_finite_transform", not_finite("px", "py", "pz")), ("error", "non_finite_quaternion", bad), ("error", "zero_quaternion", ~bad & (norm <= 1e-12)),
        ("error", "non_unit_quaternion", ~bad & (norm > 1e-12) & (F.abs(norm - 1) > unit)),
    ], F.col("node_id"))
    half, usable = world_box(q, [F.col(c) for c in ("ex", "ey", "ez")])
    boxes = nodes.where(~bad & usable & ~not_finite("px", "py", "pz", "ex", "ey", "ez") & (F.least("ex", "ey", "ez") > 0)).select(
        "clip", "node", "node_id", "grp", "class", "support",
        *[(F.col(f"p{c}") + sign * h).alias(f"{name}{c}") for c, h in zip("xyz", half) for name, sign in (("lo", -1), ("hi", 1))],
    )
    objects = boxes.where("grp = 'object'")

    def side(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.select("clip", *more, *[F.col(f"{n}{c}").alias(f"s_{n}{c}") for c in "xyz" for n in ("lo", "hi")])

    over = F.expr("lox <= s_hix AND hix >= s_lox AND loz <= s_hiz AND hiz >= s_loz")
    grounds = side(boxes.where((F.col("grp") == "static") & F.lower("class").isin(*ground_classes)), F.col("node").alias("ground"))
    deep = objects.join(grounds, "clip").where(over & (F.col("loy") < F.col("s_hiy") - contact))
    sunk = finding(deep.groupBy("clip", "node", "node_id").agg(F.min("ground").alias("ground")), "geometry", "error", "ground_penetration", F.col("node_id"))
    named = objects.join(side(boxes, F.col("node_id").alias("support")), ["clip", "support"])
    gap = F.col("loy") - F.col("s_hiy")
    code = F.when(~over, "support_no_overlap").when(gap < -contact, "support_penetration").when(gap > contact, "support_gap")
    held = named.withColumn("code", code).where("code IS NOT NULL")
    severity = F.when(F.col("code") == "support_gap", "warning").otherwise("error")
    held = held.select("clip", F.lit("geometry").alias("stage"), severity.alias("severity"), "code", F.col("node_id").alias("path"))
    return local.unionAll(sunk).unionAll(held)


def event_findings(events: DataFrame, nodes: DataFrame, durations: DataFrame) -> DataFrame:
    """Events that name an unknown node as target or partner, or come after the clip's end.

    ``events(clip, event, t, target, partner)``; a null partner is none.
    """
    ids = nodes.select("clip", F.col("node_id").alias("target")).distinct()
    path = F.concat(F.lit("/events/"), F.col("event").cast("string"))
    lost = finding(events.join(ids, ["clip", "target"], "left_anti"), "program", "error", "unknown_event_target", path)
    partners = events.where("partner IS NOT NULL").select("clip", "event", F.col("partner").alias("target"))
    alone = finding(partners.join(ids, ["clip", "target"], "left_anti"), "program", "error", "unknown_event_partner", path)
    late = finding(events.join(durations, "clip").where("t > duration"), "program", "warning", "event_after_clip", path)
    return lost.unionAll(alone).unionAll(late)


def registry_findings(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """Repeated frames and objects, one track for several objects, frame times that do not rise with their numbers.

    ``frames(clip, frame_index, t)``, ``objects(clip, object_id, track_id)``.
    """
    twice = lambda rows, key, code: finding(rows.groupBy("clip", key).count().where("count > 1"), "evidence", "error", code, F.col(key))
    shared = objects.groupBy("clip", "track_id").agg(F.countDistinct("object_id").alias("n")).where("n > 1")
    return (
        twice(frames, "frame_index", "repeated_frame").unionAll(twice(objects, "object_id", "repeated_object"))
        .unionAll(finding(shared, "evidence", "error", "shared_track", F.col("track_id"))).unionAll(time_order(frames, ["clip"], ["frame_index", "t"], "t", "frame_times_not_rising"))
    )


def visibility_findings(frames: DataFrame, pixels: DataFrame, expected: DataFrame, visible_px: int = 4) -> DataFrame:
    """Clips with another number of frames than expected, and objects that are seen in some frames only.

    ``frames(clip, frame)``, ``pixels(clip, frame, id, px)``, ``expected(clip, frames)``.
    """
    seen = frames.groupBy("clip").agg(F.countDistinct("frame").alias("recorded"))
    off = finding(expected.join(seen, "clip", "left").where("coalesce(recorded, 0) <> frames"), "render", "error", "frame_count", F.lit("/frames"))
    shown = pixels.where(F.col("px") >= visible_px).groupBy("clip", "id").agg(F.countDistinct("frame").alias("shown")).join(seen, "clip").where("shown < recorded")
    return off.unionAll(finding(shown, "render", "warning", "temporarily_visible", F.col("id")))


def first_box_comparison(boxes: DataFrame, nodes: DataFrame, tolerance: float = 0.000500001) -> DataFrame:
    """Whether each object's node still is where the object was first seen: ``clip, object_id, center, size, quat, status``.

    ``boxes(clip, object_id, t, px.., ex.., qx..)``: observed boxes, the earliest counts (without a time last, then by place); ``nodes(clip, node_id,
    px.., ex.., qx..)``. A field is null unless exactly one node has the object's id and both sides are finite numbers; opposite quaternions are one
    rotation. A changed field makes the object ``changed``, else a null one ``unavailable``.
    """
    fields = {"center": ("px", "py", "pz"), "size": ("ex", "ey", "ez"), "quat": ("qx", "qy", "qz", "qw")}
    numbers = [c for names in fields.values() for c in names]
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    first = boxes.groupBy("clip", "object_id").agg(F.min(F.struct(F.col("t").isNull().alias("late"), "t", *numbers)).alias("b"))
    own = nodes.groupBy("clip", F.col("node_id").alias("object_id")).agg(F.count(F.lit(1)).alias("nodes"), F.min(F.struct(*[finite(c).alias(c) for c in numbers])).alias("n"))
    j = first.select("clip", "object_id", "b.*").select("clip", "object_id", F.struct(*[finite(c).alias(c) for c in numbers]).alias("b")).join(own, ["clip", "object_id"], "left")
    out = {}
    for field, names in fields.items():
        all_there = F.col("nodes") == 1
        for c in names:
            all_there = all_there & F.col(f"n.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
        error = F.greatest(*[F.abs(F.col(f"n.{c}") - F.col(f"b.{c}")) for c in names])
        if field == "quat":
            error = F.least(error, F.greatest(*[F.abs(F.col(f"n.{c}") + F.col(f"b.{c}")) for c in names]))
        out[field] = F.when(all_there, error <= tolerance)
    j = j.select("clip", "object_id", *[c.alias(f) for f, c in out.items()])
    changed = ~(F.coalesce("center", F.lit(True)) & F.coalesce("size", F.lit(True)) & F.coalesce("quat", F.lit(True)))
    lacking = F.col("center").isNull() | F.col("size").isNull() | F.col("quat").isNull()
    return j.withColumn("status", F.when(changed, "changed").when(lacking, "unavailable").otherwise("matches_first_obb"))

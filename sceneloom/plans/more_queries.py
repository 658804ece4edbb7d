"""Sources, sets, generation and streaming over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions.columns import r6
from sceneloom.operators import generation as N
from sceneloom.operators import sets
from sceneloom.plans.adapters import NODES, PREDICTIONS, STATES, nodes, predictions, table
from sceneloom.plans.registry import query
from sceneloom.shared import shared_path
from sceneloom.sources import scenes
from sceneloom.streaming import jobs


@query("""WITH r AS (SELECT o_custkey AS run, o_orderpriority AS clip FROM orders) SELECT count(DISTINCT run) AS runs, count(*) - count(DISTINCT run) AS duplicates FROM r""")
def s4_read_runs(spark, d):
    return scenes.read_runs(table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("clip")))[1]


@query("SELECT event_type AS stage, 'k' || (event_id % 3) AS code, count(*) AS n FROM events GROUP BY ALL")
def s7_error_log(spark, d):
    return scenes.error_counts(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.expr("concat('k', event_id % 3)").alias("code")))


@query("""SELECT event_id, sha256('{"k":' || regexp_extract(props, '(-?[0-9]+)', 1) || '}') AS sha256 FROM events""")
def s8_content_hash(spark, d):
    return table(spark, d, "events").select("event_id", scenes.content_hash(F.col("props")).alias("sha256"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def l1_top_k(spark, d):
    return sets.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query(f"""WITH {PREDICTIONS}, e AS (SELECT DISTINCT clip, class FROM nodes), s AS (SELECT DISTINCT clip, class FROM predictions)
SELECT CASE WHEN s.clip IS NULL THEN 'missing' WHEN e.clip IS NULL THEN 'extra' ELSE 'both' END AS status, count(*) AS n FROM e FULL JOIN s ON e.clip = s.clip AND e.class = s.class GROUP BY status""")
def l2_compare_sets(spark, d):
    return sets.compare_sets(nodes(spark, d), predictions(spark, d), ["clip", "class"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 7)::INTEGER AS shard FROM orders")
def l3_shards(spark, d):
    return sets.shards(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 7)


def _u(*parts: str) -> str:
    return f"(('0x' || substr(sha256({' || chr(47) || '.join(parts)}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _seed(*parts: str) -> str:
    return f"floor({_u(*parts)} * 2147483648::DOUBLE)::BIGINT"


_FAMILIES = "[" + ", ".join(f"'{f}'" for f in N.FAMILIES) + "]"
SPECS = f"""base AS (SELECT o_orderkey AS number, 'test_' || printf('%06d', o_orderkey) AS clip, {_FAMILIES}[(o_orderkey % 5 + 1)::INT] AS family, {_seed("'test'", "o_orderkey", "'behavior'")} AS behavior_seed, {_seed("'test'", "o_orderkey", "'style'")} AS style_seed, {_seed("'test'", "o_orderkey", "'camera'")} AS camera_seed, 'base' AS kind FROM orders),
specs AS (SELECT * FROM base UNION ALL SELECT * REPLACE (clip || '_s' AS clip, 'style' AS kind, {_seed("'test'", "number", "'style'", "'1'")} AS style_seed) FROM base WHERE number < 500
  UNION ALL SELECT * REPLACE (clip || '_b' AS clip, 'behavior' AS kind, {_seed("'test'", "number", "'behavior'", "'1'")} AS behavior_seed) FROM base WHERE number < 500)"""


def _specs(spark, d):
    return N.expand_specs(table(spark, d, "orders"), "o_orderkey", "test", 500)


@query(f"WITH {SPECS} SELECT * FROM specs")
def n1_expand_specs(spark, d):
    return _specs(spark, d)


@query(None)
def n2_generate_scenes(spark, d):
    return N.generate_scenes(_specs(spark, d))


def _stage(axis: str, other: tuple[float, float], corridor: tuple[float, float]) -> str:
    u = _u("camera_seed::VARCHAR", "'stage'", f"'{axis}'")
    at = lambda lo, hi: f"round({lo}::DOUBLE + {hi - lo}::DOUBLE * {u}, 2)"
    return f"CASE family WHEN 'corridor' THEN {at(*corridor)} WHEN 'track' THEN {at(16.0, 26.0)} ELSE {at(*other)} END"


def _in(lo: str, hi: str, *key: str) -> str:
    return f"round({lo} + ({hi} - {lo}) * {_u('behavior_seed::VARCHAR', chr(39) + 'layout' + chr(39), *key)}, 2)"


def _some(least: int, most: int) -> str:
    return f"{least} + floor({_u('behavior_seed::VARCHAR', chr(39) + 'layout' + chr(39), chr(39) + 'count' + chr(39))} * {most - least + 1})::INT"


def _d(x: float) -> str:
    return f"{x}::DOUBLE"


def _nth(k: str, lo: str, hi: str) -> str:
    return _in(lo, hi, f"'{k}'", "i::VARCHAR")


LAYOUTS = f"""{SPECS}, stage AS (SELECT *, CASE family WHEN 'room' THEN {_in(_d(2.6), _d(4.2), "'height'")} ELSE {_in(_d(2.4), _d(3.6), "'height'")} END AS h,
  CASE family WHEN 'platform' THEN {_some(2, 4)} WHEN 'track' THEN {_some(6, 10)} WHEN 'yard' THEN {_some(1, 3)} ELSE 0 END AS count
  FROM (SELECT *, {_stage('width', (10.0, 22.0), (4.0, 7.0))} AS w, {_stage('depth', (10.0, 22.0), (18.0, 30.0))} AS d FROM specs)),
nth AS (SELECT *, unnest(range(1, count + 1)) AS i FROM stage),
layouts AS (SELECT clip, family, 'ground' AS node_id, 'ground' AS class, 0::DOUBLE AS px, -0.2::DOUBLE AS py, 0::DOUBLE AS pz, w AS ex, 0.4::DOUBLE AS ey, d AS ez FROM stage
  UNION ALL SELECT clip, family, 'wall_' || s[1], 'wall', CASE s[1] WHEN 'w' THEN -w / 2 WHEN 'e' THEN w / 2 ELSE 0 END, h / 2, CASE s[1] WHEN 'n' THEN -d / 2 WHEN 's' THEN d / 2 ELSE 0 END,
    CASE WHEN s[1] IN ('n', 's') THEN w ELSE 0.3::DOUBLE END, h, CASE WHEN s[1] IN ('n', 's') THEN 0.3::DOUBLE ELSE d END FROM (SELECT *, unnest(CASE family WHEN 'room' THEN ['n', 's', 'w', 'e'] ELSE ['w', 'e'] END) AS s FROM stage WHERE family IN ('room', 'corridor'))
  UNION ALL SELECT clip, family, 'platform_' || i, 'platform', {_nth('px', '-w / 3', 'w / 3')}, {_nth('py', _d(0.8), _d(3.0))}, {_nth('pz', '-d / 3', 'd / 3')}, {_nth('ex', _d(2.0), _d(4.5))}, {_nth('ey', _d(0.3), _d(0.6))}, {_nth('ez', _d(2.0), _d(4.5))} FROM nth WHERE family = 'platform'
  UNION ALL SELECT clip, family, 'rail_' || i, 'rail', (least(w, d) / 2 - 1.5::DOUBLE) * cos(2 * pi() * (i - 1) / count), 0.125::DOUBLE, (least(w, d) / 2 - 1.5::DOUBLE) * sin(2 * pi() * (i - 1) / count), 1.6::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE FROM nth WHERE family = 'track'
  UNION ALL SELECT clip, family, 'block_' || i, 'block', {_nth('px', '-w / 3', 'w / 3')}, {_nth('ey', _d(1.0), _d(2.6))} / 2, {_nth('pz', '-d / 3', 'd / 3')}, {_nth('ex', _d(1.5), _d(3.5))}, {_nth('ey', _d(1.0), _d(2.6))}, {_nth('ez', _d(1.5), _d(3.5))} FROM nth WHERE family = 'yard')"""


@query(f"WITH {LAYOUTS} SELECT clip, family, node_id, class, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in ("px", "py", "pz", "ex", "ey", "ez")) + " FROM layouts")
def n2_layouts(spark, d):
    out = N.generate_layout(_specs(spark, d))
    return out.select("clip", "family", "node_id", "class", *[r6(F.col(c)).alias(c) for c in ("px", "py", "pz", "ex", "ey", "ez")])


@query(None)
def n2_scenes_in_layouts(spark, d):
    return N.generate_in_layout(_specs(spark, d))


_PALETTE = "[" + ", ".join(f"'{p}'" for p in N.PALETTE) + "]"


def _channel(k: str) -> str:
    u = _u("(clip % 50)::VARCHAR", "node::VARCHAR", f"'{k}'")
    return f"lpad(lower(hex(floor(255 * (0.5 + CASE WHEN grp = 'static' THEN 0.15 ELSE 0.7 END::DOUBLE * ({u} - 0.5)) + 0.5)::BIGINT)), 2, '0')"


@query(f"""WITH {NODES} SELECT clip, node, {_PALETTE}[floor({_u("(clip % 50)::VARCHAR", "node::VARCHAR", "'material'")} * 6)::INT + 1] AS material, '#' || {_channel('r')} || {_channel('g')} || {_channel('b')} AS base_color FROM nodes""")
def n3_generate_style(spark, d):
    n = nodes(spark, d).withColumn("style_seed", F.col("clip") % 50)
    return N.generate_style(n, "style_seed", "node", F.col("grp") == "static").select("clip", "node", "material", "base_color")


@query("""SELECT item_id AS base, item_id::VARCHAR || '_s' || s AS variant, sha256(text) AS source_sha256, sha256(sha256(text) || '/' || s) AS lineage_sha256 FROM benchmark, (SELECT unnest([3, 8]) AS s)""")
def n4_style_pairs(spark, d):
    return N.style_pairs(table(spark, d, "benchmark"), "item_id", "text", [8, 3, 8])


@query(f"""WITH {NODES}, m AS (SELECT clip, node, px, ['static', 'prismatic', 'periodic_translate', 'trajectory', 'spin'][(node % 5 + 1)::INT] AS motion, ex AS amp, 1 + ez * 10 AS period FROM nodes), f AS (SELECT m.*, frame, frame / 2::DOUBLE AS t FROM m, (SELECT unnest(range(5)) AS frame))
SELECT motion, frame::INTEGER AS frame, count(*) AS n, round(avg(px + CASE motion WHEN 'prismatic' THEN amp * (t / 2) WHEN 'periodic_translate' THEN amp * sin(6.283185307179586 * t / period) WHEN 'trajectory' THEN amp * (1 - abs(2 * (t / 2) - 1)) ELSE 0 END), 5) AS px, round(avg(CASE WHEN motion = 'spin' THEN 360 * t / period ELSE 0 END), 5) AS angle_deg FROM f GROUP BY ALL""")
def t11_materialise_states(spark, d):
    motion = F.array(*[F.lit(m) for m in ("static", "prismatic", "periodic_translate", "trajectory", "spin")])[F.expr("cast(node % 5 AS int)")]
    n = nodes(spark, d).select("clip", "node", motion.alias("motion"), "px", "py", "pz", F.col("ex").alias("amp"), (1 + F.col("ez") * 10).alias("period"))
    s = N.materialise_states(n, 2.0, 2.0).join(n.select("clip", "node", "motion"), ["clip", "node"])
    return s.groupBy("motion", "frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("px"), 5).alias("px"), F.round(F.avg("angle_deg"), 5).alias("angle_deg"))


@query(f"""WITH {NODES}, q AS (SELECT *, 1 + 0.006::DOUBLE * (node % 7) AS norm, CASE WHEN node % 3 = 0 THEN NULL ELSE py - ey / 2 - 0.03::DOUBLE * (node % 8) END AS top, node % 2 = 0 AS agrees FROM nodes), g AS (SELECT *, abs(norm - 1) AS off, py - ey / 2 - top AS gap FROM q)
SELECT CASE WHEN off <= 1e-3 THEN 'unit' WHEN off <= 0.02 THEN 'normalised' ELSE 'unresolved' END AS quaternion, CASE WHEN gap IS NULL THEN 'no_support' WHEN abs(gap) <= 0.05 THEN 'resting' WHEN abs(gap) <= 0.12 AND agrees THEN 'snapped' WHEN abs(gap) <= 0.12 THEN 'no_evidence' ELSE 'too_far' END AS support, count(*) AS n FROM g GROUP BY ALL""")
def v8_repair_candidates(spark, d):
    n = nodes(spark, d).withColumns({"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.expr("1 + 0.006D * (node % 7)"), "support_top": F.expr("CASE WHEN node % 3 = 0 THEN NULL ELSE py - ey / 2 - 0.03D * (node % 8) END"), "agrees": F.col("node") % 2 == 0})
    return N.repair(n).groupBy("quaternion", "support").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark, d):
    ev = jobs.read_stream(spark, f"{d}/events.parquet")
    ts = F.expr("cast(convert_timezone('UTC', current_timezone(), cast(ts AS timestamp_ntz)) AS timestamp)")
    return ev.select(F.col("user_id").alias("clip"), F.col("event_type").alias("instance"), F.col("event_id"), ts.alias("ts"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


@query(None)
def x1_streaming_association(spark, d):
    s = _event_stream(spark, d)
    det = s.select("clip", F.col("event_id").alias("detection_id"), F.floor(F.unix_micros("ts") / 3_600_000_000).cast("int").alias("frame"), F.col("instance").alias("label"), (F.col("x") / 100).alias("score"), F.col("x").alias("x1"),
                   F.col("y").alias("y1"), (F.col("x") + 30).alias("x2"), (F.col("y") + 40).alias("y2"), "ts")
    return jobs.drain(jobs.associate_stream(det), shared_path(spark, "association"))


@query(f"""WITH {STATES} SELECT strftime(to_timestamp(floor(t / 86400) * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, clip, instance, count(*) AS n, round(avg(x), 6) AS mean_x FROM states GROUP BY ALL""")
def x2_track_health(spark, d):
    out = jobs.drain(jobs.track_health(_event_stream(spark, d)), shared_path(spark, "health"), "complete")
    day = F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd")
    return out.select(day.alias("day"), "clip", "instance", "n", r6(F.col("mean_x")).alias("mean_x"))


@query(f"""WITH {STATES}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY clip, instance ORDER BY t) >= 43200, true) AS brk FROM states), s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY clip, instance ORDER BY t, event_id) AS session FROM g)
SELECT clip, instance, count(*) AS sessions, max(n) AS longest FROM (SELECT clip, instance, session, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL""")
def x2_track_sessions(spark, d):
    out = jobs.drain(jobs.track_sessions(_event_stream(spark, d)), shared_path(spark, "sessions"), "complete")
    return out.groupBy("clip", "instance").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))




@query(f"""WITH {NODES}, p AS (SELECT clip, node, ex AS e, t, ['prismatic', 'revolute', 'periodic_rotate', 'trajectory', 'static'][(node % 5 + 1)::INT] AS motion, px FROM nodes, (SELECT unnest([0.0, 0.75, 1.75, 2.25, 3.0]::DOUBLE[]) AS t)),
v AS (SELECT *, CASE WHEN t < 0.5 THEN 0 WHEN t < 1.5 THEN e * (t - 0.5) WHEN t < 2 THEN e WHEN t < 2.5 THEN e + (-e - e) * ((t - 2) / 0.5) ELSE -e END AS told FROM p)
SELECT motion, t, count(*) AS n, round(avg(CASE motion WHEN 'prismatic' THEN px + told WHEN 'trajectory' THEN CASE WHEN t <= 1 THEN px + (e * 2) * t WHEN t <= 2 THEN px + e * 2 + (0 - e * 2) * (t - 1) ELSE px END ELSE px END), 5) AS px,
  round(avg(CASE motion WHEN 'revolute' THEN told WHEN 'periodic_rotate' THEN e * sin(6.283185307179586 * t / 2.0 + 0.5) ELSE 0 END), 5) + 0.0::DOUBLE AS angle_deg FROM v GROUP BY ALL""")
def t11_sample_motion(spark, d):
    from sceneloom.operators.motion import sample_motion

    pick = F.array(*[F.lit(m) for m in ("prismatic", "revolute", "periodic_rotate", "trajectory", "static")])[F.expr("cast(node % 5 AS int)")]
    e = F.col("ex")
    moves = F.array(F.struct(F.lit(0.5).alias("t"), e.alias("to"), F.lit(1.0).alias("duration")), F.struct(F.lit(2.0).alias("t"), (-e).alias("to"), F.lit(0.5).alias("duration")))
    frame = lambda t, x: F.struct(F.lit(t).alias("t"), F.array(x, F.col("py"), F.col("pz")).alias("pos"))
    n = nodes(spark, d).select(
        "clip", "node", pick.alias("motion"), F.array("px", "py", "pz").alias("pos"), F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]).alias("quat"), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0)]).alias("axis"), F.lit(0.0).alias("start"),
        F.lit(0.0).alias("rate"), e.alias("amp"), F.lit(2.0).alias("period"), F.lit(0.5).alias("phase"), moves.alias("schedule"), F.array(frame(0.0, F.col("px")), frame(1.0, F.col("px") + e * 2), frame(2.0, F.col("px"))).alias("keyframes"), F.lit(False).alias("smooth"),
    )
    s = sample_motion(n, F.array(*[F.lit(t) for t in (0.0, 0.75, 1.75, 2.25, 3.0)])).join(n.select("clip", "node", "motion"), ["clip", "node"])
    return s.groupBy("motion", "t").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("pos")[0]), 5).alias("px"), (F.round(F.avg("angle_deg"), 5) + F.lit(0.0)).alias("angle_deg"))

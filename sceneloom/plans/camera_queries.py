"""New cameras over orders: an order is a clip with a camera of three key frames, its open lines are the objects."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sceneloom.functions.columns import r6
from sceneloom.operators import cameras
from sceneloom.plans.adapters import NODES, nodes, table
from sceneloom.plans.registry import query

VIEWS, SEED = 2, 17
PATH = cameras.Path()


def _tables(spark, d):
    orders = table(spark, d, "orders")
    fov = F.when(F.col("o_orderkey") % 3 != 0, (F.lit(50) + F.col("o_custkey") % 20).cast("double"))
    clips = orders.select(F.col("o_orderkey").alias("clip"), (F.lit(4) + F.col("o_custkey") % 5).cast("double").alias("duration"), fov.alias("fov_deg"), F.col("o_custkey").alias("c"))
    k = clips.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    frames = k.select(
        "clip", F.expr("k * duration / 2").alias("t"), F.expr("cast(c % 9 + k AS double)").alias("x"), F.expr("2 + k / 2D").alias("y"), F.expr("cast(c % 7 - k AS double)").alias("z"),
        F.expr("cast(c % 4 AS double)").alias("lx"), F.lit(0.5).alias("ly"), F.expr("if(clip % 5 <> 0, 1D, null)").alias("lz"),
    )
    own = nodes(spark, d).where("grp = 'object'")
    anchors = own.select("clip", "node", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), cameras.anchor_size(F.array("ex", "ey", "ez"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("size"))
    return clips.drop("c"), frames, anchors


def _paths(spark, d, mode):
    out = cameras.camera_paths(*_tables(spark, d), mode, VIEWS, SEED, PATH)
    return out.select("clip", "view", "name", *[r6(F.col(c)).alias(c) for c in ("t", "x", "y", "z", "lx", "ly", "lz")])


def _uniform(*parts: str) -> str:
    return f"('0x' || substr(sha256(concat_ws('/', seed, view, {', '.join(parts)})), 1, 8))::BIGINT / 4294967296::DOUBLE"


TWO_PI = f"{2 * math.pi!r}::DOUBLE"
TABLES = f"""{NODES}, clips AS (SELECT o_orderkey AS clip, (4 + o_custkey % 5)::DOUBLE AS duration, CASE WHEN o_orderkey % 3 <> 0 THEN (50 + o_custkey % 20)::DOUBLE END AS fov_deg, o_custkey AS c FROM orders),
v AS (SELECT *, clip::VARCHAR || '_v' || view AS name, xor({SEED}::BIGINT, ('0x' || substr(sha256(clip::VARCHAR), 1, 8))::BIGINT) AS seed FROM (SELECT *, unnest(range({VIEWS}))::INTEGER AS view FROM clips)),
frames AS (SELECT clip, view, name, k * duration / 2 AS t, (c % 9 + k)::DOUBLE AS x, 2 + k / 2::DOUBLE AS y, (c % 7 - k)::DOUBLE AS z, (c % 4)::DOUBLE AS lx, 0.5::DOUBLE AS ly, CASE WHEN clip % 5 <> 0 THEN 1::DOUBLE END AS lz
  FROM (SELECT *, unnest(range(3)) AS k FROM v)),
anchors AS (SELECT clip, node, px AS x, py AS y, pz AS z, greatest(ex, ey, ez, {cameras.LEAST_SIZE}::DOUBLE) AS size, row_number() OVER (PARTITION BY clip ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM nodes WHERE grp = 'object'),
away AS (SELECT *, x - lx AS dx, y - ly AS dy, z - z0 AS dz FROM (SELECT *, coalesce(lz, 0) AS z0 FROM frames)),
pulled AS (SELECT *, CASE WHEN far >= 1e-6 THEN greatest({cameras.NEAREST}::DOUBLE, far * {PATH.closeness}::DOUBLE) / far ELSE 1 END AS s FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS far FROM away))"""
COLUMNS = "clip, view, name, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in ("t", "x", "y", "z", "lx", "ly", "lz"))


def _orbit(phi: str) -> str:
    return f"""SELECT clip, view, name, t, lx + dx * s * cos({phi}) - dz * s * sin({phi}) AS x, greatest({cameras.LOWEST}::DOUBLE, ly + dy * s) AS y, z0 + dx * s * sin({phi}) + dz * s * cos({phi}) AS z, lx, ly, z0 AS lz FROM pulled"""


@query(f"WITH {TABLES}, o AS ({_orbit(f'({TWO_PI} * view / {VIEWS}::DOUBLE)')}) SELECT {COLUMNS} FROM o")
def p15_near_orbit(spark, d):
    return _paths(spark, d, "near_orbit")


@query(f"""WITH {TABLES}, stops AS (SELECT v.clip, view, name, seed, duration, a.n, x, z, y, row_number() OVER (PARTITION BY v.clip, view ORDER BY {_uniform("'order'", 'node')}, node) - 1 AS i, {TWO_PI} * {_uniform("'stop'", 'node')} AS turn FROM v JOIN anchors a ON a.clip = v.clip),
placed AS (SELECT *, x + {PATH.standoff}::DOUBLE * cos(turn) AS wx, z + {PATH.standoff}::DOUBLE * sin(turn) AS wz FROM stops),
way AS (SELECT clip, view, i, wx, wz FROM placed UNION ALL SELECT clip, view, 1, wx + {2 * PATH.standoff}::DOUBLE * cos(e), wz + {2 * PATH.standoff}::DOUBLE * sin(e) FROM (SELECT *, {TWO_PI} * {_uniform("'end'")} AS e FROM placed WHERE n = 1)),
s AS (SELECT *, u * (m - 1) AS s, least(floor(u * (m - 1))::BIGINT, m - 2) AS j FROM (SELECT *, k / {PATH.count - 1}::DOUBLE AS u FROM (SELECT clip, view, name, duration, n, greatest(n, 2) AS m, unnest(range({PATH.count})) AS k FROM placed WHERE i = 0))),
w AS (SELECT s.clip, s.view, s.name, duration * u AS t, a.wx + (b.wx - a.wx) * (s - j) AS x, greatest({PATH.height}, {cameras.LOWEST})::DOUBLE AS y, a.wz + (b.wz - a.wz) * (s - j) AS z, l.x AS lx, l.y AS ly, l.z AS lz
  FROM s JOIN way a ON a.clip = s.clip AND a.view = s.view AND a.i = j JOIN way b ON b.clip = s.clip AND b.view = s.view AND b.i = j + 1
  JOIN (SELECT clip, view, i, x, y, z FROM stops) l ON l.clip = s.clip AND l.view = s.view AND l.i = least(j + 1, s.n - 1)
  UNION ALL SELECT * FROM frames WHERE clip NOT IN (SELECT clip FROM anchors)) SELECT {COLUMNS} FROM w""")
def p15_walkthrough(spark, d):
    return _paths(spark, d, "walkthrough")


@query(f"""WITH {TABLES}, o AS (SELECT v.clip, view, name, duration, x, y, z, greatest({cameras.NEAREST}::DOUBLE, size / (tan(radians(coalesce(fov_deg, {cameras.FIELD_OF_VIEW})) / 2) * {2 * PATH.fraction!r}::DOUBLE)) AS d, {TWO_PI} * {_uniform("'start'")} AS a0,
  0.25::DOUBLE + 0.5::DOUBLE * {_uniform("'rise'")} AS rise, CASE WHEN {_uniform("'side'")} < 0.5 THEN -1 ELSE 1 END * {math.pi!r}::DOUBLE * (0.5::DOUBLE + 0.6::DOUBLE * {_uniform("'sweep'")}) AS sweep FROM v JOIN anchors a ON a.clip = v.clip AND a.i = view % a.n),
s AS (SELECT *, a0 + sweep * u AS a FROM (SELECT *, k / {PATH.count - 1}::DOUBLE AS u FROM (SELECT *, unnest(range({PATH.count})) AS k FROM o))),
w AS (SELECT clip, view, name, duration * u AS t, x + d * cos(a) AS x, greatest({cameras.LOWEST}::DOUBLE, y + rise * d) AS y, z + d * sin(a) AS z, x AS lx, y AS ly, z AS lz FROM s
  UNION ALL SELECT * FROM ({_orbit('0')}) WHERE clip NOT IN (SELECT clip FROM anchors)) SELECT {COLUMNS} FROM w""")
def p15_object_centric(spark, d):
    return _paths(spark, d, "object_centric")

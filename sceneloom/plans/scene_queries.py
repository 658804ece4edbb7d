"""Scene-node, rule and join operators over order lines, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions import columns as C
from sceneloom.functions.columns import r6
from sceneloom.operators import rules, scene
from sceneloom.plans.adapters import NODES, PREDICTIONS, STATES, nodes, predictions, states, table
from sceneloom.plans.registry import query

VOCABULARY = ("floor", "Floor mat", "table", "tablecloth", " Wall ", "rail", "garden slide", "carpet", "lava pool", "crate")
NAMES = "list_extract([" + ", ".join(f"'{v}'" for v in VOCABULARY) + "], ((clip + node) % 10 + 1)::INT)"


def _named(df):
    """Nodes with a class name dealt from a fixed vocabulary."""
    return df.withColumn("name", F.array(*[F.lit(v) for v in VOCABULARY])[F.expr("cast((clip + node) % 10 AS int)")])


@query(f"""WITH {NODES}, g AS (SELECT *, ['box', 'sphere', 'cylinder', 'cone'][(node % 4 + 1)::INT] AS shape, ex / 2 AS radius, CASE WHEN node % 3 = 0 THEN NULL ELSE ey END AS height FROM nodes),
e AS (SELECT clip, node, CASE shape WHEN 'sphere' THEN [2 * radius, 2 * radius, 2 * radius] WHEN 'box' THEN [ex, ey, ez] ELSE [2 * radius, coalesce(height, 2 * radius), 2 * radius] END AS e FROM g)
SELECT clip, node, round(e[1], 6) AS x, round(e[2], 6) AS y, round(e[3], 6) AS z FROM e""")
def p1_node_extent(spark, d):
    n = nodes(spark, d)
    shape = F.array(*[F.lit(s) for s in ("box", "sphere", "cylinder", "cone")])[F.expr("cast(node % 4 AS int)")]
    e = C.node_extent(shape, F.col("ex") / 2, F.expr("CASE WHEN node % 3 = 0 THEN NULL ELSE ey END"), F.array("ex", "ey", "ez"))
    return n.withColumn("e", e).select("clip", "node", *[r6(F.col("e")[i]).alias(c) for i, c in enumerate("xyz")])


@query("""WITH p AS (SELECT p_partkey, ['primitive', 'composite', 'asset', 'generated', 'other'][(p_partkey % 5 + 1)::INT] AS kind, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'cone' END AS shape,
  CASE WHEN p_partkey % 7 = 0 THEN 'r' ELSE '' END AS ref, lower(p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN kind = 'primitive' THEN coalesce(shape, 'box') WHEN kind = 'composite' THEN 'composite' WHEN kind IN ('asset', 'generated') THEN CASE WHEN ref <> '' THEN 'mesh'
  WHEN regexp_matches(n, 'coin|disc|ring|wheel') THEN 'cylinder' WHEN regexp_matches(n, 'ball|sphere|orb|marble') THEN 'sphere' WHEN regexp_matches(n, 'tree|plant|bush') THEN 'composite'
  WHEN regexp_matches(n, 'train|car|cart|vehicle|truck|bus|locomotive') THEN 'composite' ELSE 'box' END END AS shape FROM p""")
def p2_effective_shape(spark, d):
    p = table(spark, d, "part")
    kind = F.array(*[F.lit(k) for k in ("primitive", "composite", "asset", "generated", "other")])[F.expr("cast(p_partkey % 5 AS int)")]
    return p.select("p_partkey", C.effective_shape(kind, F.expr("CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'cone' END"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'r' ELSE '' END"), F.col("p_name")).alias("shape"))


RATIO = "list_transform(list_reverse_sort([{0}ex, {0}ey, {0}ez]), lambda e: e / greatest({0}ex, {0}ey, {0}ez))"


@query(f"""WITH {PREDICTIONS}, j AS (SELECT g.clip, g.node, {RATIO.format('g.')} AS a, {RATIO.format('p.')} AS b, greatest(p.ex, p.ey, p.ez) / greatest(g.ex, g.ey, g.ez) AS s
  FROM nodes g JOIN predictions p USING (clip, node))
SELECT clip, node, round((abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 3, 6) AS shape_error, round(s, 6) AS scale_ratio FROM j""")
def p3_shape_scale_agreement(spark, d):
    g = nodes(spark, d).select("clip", "node", F.array("ex", "ey", "ez").alias("a"))
    p = predictions(spark, d).select("clip", "node", F.array("ex", "ey", "ez").alias("b"))
    return g.join(p, ["clip", "node"]).select("clip", "node", r6(C.shape_error(F.col("a"), F.col("b"))).alias("shape_error"), r6(C.scale_ratio(F.col("a"), F.col("b"))).alias("scale_ratio"))


@query(f"""WITH {NODES}, l AS (SELECT clip, node, CASE node % 3 WHEN 0 THEN greatest(ex, ey, ez) WHEN 1 THEN greatest(2 * ex, ey) ELSE 0 END AS e FROM nodes)
SELECT clip, node, CASE WHEN e > 1e-6 THEN round(e, 6) END AS longest FROM l""")
def p4_longest_edge(spark, d):
    n = nodes(spark, d)
    zero = F.lit(0.0)
    extent = F.when(F.col("node") % 3 == 0, F.array("ex", "ey", "ez"))
    radius = F.when(F.col("node") % 3 == 1, F.col("ex")).otherwise(zero)
    height = F.when(F.col("node") % 3 == 1, F.col("ey")).otherwise(zero)
    return n.select("clip", "node", r6(C.longest_edge(extent, F.lit(None).cast("array<double>"), radius, height)).alias("longest"))


STATIC_LIST = "[" + ", ".join(f"'{c}'" for c in C.STATIC_CLASSES) + "]"
GROUND_LIST = ", ".join(f"'{c}'" for c in C.GROUND_CLASSES)
RIGID_LIST = ", ".join(f"'{c}'" for c in C.RIGID_STRUCTURE_CLASSES)


@query(f"""WITH {NODES}, n AS (SELECT clip, node, {NAMES} AS name FROM nodes)
SELECT name, lower(trim(name)) IN ({GROUND_LIST}) AS ground, lower(trim(name)) IN ({RIGID_LIST}) AS rigid, list_has_any(regexp_split_to_array(lower(name), '[^a-z0-9]+'), {STATIC_LIST}) AS static,
  regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS n FROM n GROUP BY ALL""")
def p5_class_taxonomy(spark, d):
    n = _named(nodes(spark, d))
    name = F.col("name")
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(
        "name", C.is_ground(name).alias("ground"), C.is_rigid_structure(name).alias("rigid"), C.is_static(name).alias("static"), C.slug(name).alias("slug"), "n"
    )


@query(f"""WITH {NODES}, n AS (SELECT *, {NAMES} AS name, ex / 12 AS mask_area, CASE WHEN node % 4 = 0 THEN 'trajectory' WHEN node % 4 = 1 THEN 'unknown' END AS motion, node % 2 = 1 AS moves FROM nodes),
f AS (SELECT *, list_has_any(regexp_split_to_array(lower(name), '[^a-z0-9]+'), {STATIC_LIST}) AS st, coalesce(motion, 'static') NOT IN ('static', 'unknown') AS typed, lower(trim(name)) IN ({RIGID_LIST}) AS rigid FROM n)
SELECT clip, node, mask_area >= 0.35 OR lower(trim(name)) IN ({GROUND_LIST}) OR (st AND NOT CASE WHEN rigid THEN typed ELSE typed OR moves END) AS structure FROM f""")
def p6_route_structure(spark, d):
    n = _named(nodes(spark, d))
    motion = F.expr("CASE WHEN node % 4 = 0 THEN 'trajectory' WHEN node % 4 = 1 THEN 'unknown' END")
    return n.select("clip", "node", scene.route_structure(F.col("name"), F.col("ex") / 12, motion, F.col("node") % 2 == 1).alias("structure"))


@query("""WITH b AS (SELECT l_suppkey AS clip, l_returnflag AS object, l_shipdate AS t, l_orderkey, l_linenumber, l_quantity AS px, l_discount AS py, l_tax AS pz, l_quantity / 100 AS ex, l_linestatus = 'F' AS s FROM lineitem)
SELECT clip, object, round(min_by(px, t::VARCHAR || '/' || lpad(l_orderkey::VARCHAR, 10, '0') || '/' || l_linenumber || '/' || lpad(px::VARCHAR, 8, '0') || py || pz), 6) AS px, round(greatest(quantile_cont(ex, 0.5), 0.05), 6) AS ex, CASE WHEN bool_or(s) THEN 'static' ELSE 'object' END AS grp, count(*) AS frames FROM b GROUP BY ALL""")
def p7_evidence_to_nodes(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("clip"), F.col("l_returnflag").alias("object"), F.col("l_quantity").alias("px"), F.col("l_discount").alias("py"), F.col("l_tax").alias("pz"),
        (F.col("l_quantity") / 100).alias("ex"), F.lit(1.0).alias("ey"), F.lit(1.0).alias("ez"), (F.col("l_linestatus") == "F").alias("s"),
        F.expr("concat(cast(l_shipdate AS string), '/', lpad(cast(l_orderkey AS string), 10, '0'), '/', l_linenumber, '/', lpad(cast(l_quantity AS string), 8, '0'), cast(l_discount AS string), cast(l_tax AS string))").alias("t"),
    )
    out = scene.evidence_to_nodes(li, ["clip", "object"], "t", F.col("s"))
    return out.select("clip", "object", r6(F.col("px")).alias("px"), r6(F.col("ex")).alias("ex"), "grp", "frames")


@query(f"""WITH {STATES}, w AS (SELECT *, first(x) OVER o AS f, count(*) OVER (PARTITION BY clip, instance) AS n, row_number() OVER (PARTITION BY clip, instance ORDER BY t) - 1 AS i FROM states WINDOW o AS (PARTITION BY clip, instance ORDER BY t)),
m AS (SELECT *, max(abs(x - f)) OVER (PARTITION BY clip, instance) AS far FROM w)
SELECT clip, instance, round(t, 6) AS t, x FROM m WHERE n >= 3 AND far >= 0.4 * 100::DOUBLE AND (n <= 12 OR list_contains(list_transform(range(12), lambda j: round_even(j * (n - 1) / 11::DOUBLE, 0)::BIGINT), i))""")
def p8_motion_params(spark, d):
    return scene.motion_params(states(spark, d), ["clip", "instance"], "t", "x", F.lit(100.0)).withColumn("t", r6(F.col("t")))


@query(f"""WITH l AS (SELECT DISTINCT p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' big' WHEN 2 THEN '  ##x' ELSE '' END AS label FROM part UNION SELECT DISTINCT substr(p_name, 1, 4 + (p_partkey % 5)::INT) FROM part),
c AS (SELECT label, trim(regexp_replace(regexp_replace(lower(label), '\\s*##', '', 'g'), '\\s+', ' ', 'g')) AS l FROM l), p AS (SELECT DISTINCT p_name AS phrase FROM part),
i AS (SELECT label, phrase, CASE WHEN l = phrase THEN 0 ELSE 1 END AS rule FROM c JOIN p ON contains(' ' || l || ' ', ' ' || phrase || ' ')),
f AS (SELECT label, min(phrase) AS phrase, 2 AS rule FROM c JOIN p ON length(l) >= 3 AND contains(phrase, l) GROUP BY label HAVING count(DISTINCT phrase) = 1),
b AS (SELECT label, phrase FROM (SELECT * FROM i UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY label ORDER BY rule, length(phrase) DESC, phrase) = 1)
SELECT label, coalesce(phrase, label) AS snapped FROM c LEFT JOIN b USING (label)""")
def p9_snap_label(spark, d):
    p = table(spark, d, "part")
    labels = p.select(F.expr("concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' big' WHEN 2 THEN '  ##x' ELSE '' END)").alias("label"))
    labels = labels.union(p.select(F.expr("substring(p_name, 1, cast(4 + p_partkey % 5 AS int))")))
    return scene.snap_label(labels, p.select(F.col("p_name").alias("phrase")))


@query(f"""WITH {NODES}, f AS (SELECT o_orderkey AS clip, 1 + (o_custkey % 4) / 4::DOUBLE AS k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT clip, node, round(px * coalesce(k, 1), 6) AS px, round(ez * coalesce(k, 1), 6) AS ez, coalesce(k, 1) AS stage_scale FROM nodes LEFT JOIN f USING (clip)""")
def p10_scale_program(spark, d):
    f = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("clip"), F.expr("1 + (o_custkey % 4) / 4D").alias("k"))
    return scene.scale_nodes(nodes(spark, d), f, ["clip"]).select("clip", "node", r6(F.col("px")).alias("px"), r6(F.col("ez")).alias("ez"), "stage_scale")


@query(f"""WITH {PREDICTIONS}, b AS (SELECT clip, node, py, ey FROM nodes WHERE (clip + node) % 5 <> 0), v AS (SELECT clip, node, py, ey FROM predictions), sb AS (SELECT clip, node, class FROM nodes WHERE (clip + node) % 5 <> 0), sv AS (SELECT clip, node, class FROM predictions)
SELECT 'behaviour' AS half, (SELECT count(*) FROM ((FROM b EXCEPT ALL FROM v) UNION ALL (FROM v EXCEPT ALL FROM b))) AS differing
UNION ALL SELECT 'style', (SELECT count(*) FROM ((FROM sb EXCEPT ALL FROM sv) UNION ALL (FROM sv EXCEPT ALL FROM sb)))""")
def p11_style_behaviour_halves(spark, d):
    b, v = nodes(spark, d).where("(clip + node) % 5 <> 0"), predictions(spark, d)
    out = None
    for half, cols in (("behaviour", ["clip", "node", "py", "ey"]), ("style", ["clip", "node", "class"])):
        one = scene.differing(b, v, cols).agg(F.count(F.lit(1)).alias("differing")).select(F.lit(half).alias("half"), "differing")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"""WITH {NODES}, n AS (SELECT *, {NAMES} AS name FROM nodes), g AS (SELECT clip, arg_max(py + ey / 2, row(ex * ez, -node)) AS level FROM n WHERE grp = 'static' GROUP BY clip)
SELECT role, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(name), 'lava|spike|water|fire|acid') THEN 'hazard' WHEN grp = 'static' THEN 'static_structure' WHEN ex * ez >= 0.45 AND node % 2 = 0 THEN 'dynamic_platform' WHEN ex * ez >= 0.45 THEN 'platform'
  WHEN greatest(ex, ey, ez) <= 1.4 AND list_sort([ex, ey, ez])[2] / greatest(ex, ey, ez) >= 0.3 AND py - coalesce(level, 0) <= 2.7 THEN 'collectible' WHEN node % 2 = 0 AND py - coalesce(level, 0) <= 2.7 THEN 'moving_obstacle' ELSE 'decoration' END AS role
  FROM n LEFT JOIN g USING (clip)) GROUP BY role""")
def p12_affordance(spark, d):
    n = _named(nodes(spark, d)).drop("class").withColumnRenamed("name", "class")
    return scene.affordance(n, scene.ground_level(n), F.col("node") % 2 == 0).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NODES}, r AS (SELECT clip, node, px + 0.3::DOUBLE * (node % 4) AS sx, py AS sy, pz AS sz FROM nodes WHERE node % 5 <> 0), m AS (SELECT n.*, sx, sqrt((sx - px) ** 2 + (sy - py) ** 2 + (sz - pz) ** 2) AS moved FROM nodes n LEFT JOIN r USING (clip, node))
SELECT clip, node, round(CASE WHEN moved BETWEEN 0.01 AND 0.8 THEN sx ELSE px END, 6) AS px, coalesce(moved BETWEEN 0.01 AND 0.8, false) AS settled, CASE WHEN moved > 0.8 THEN 'shift_exceeds_limit' END AS reason FROM m""")
def p13_apply_settled(spark, d):
    n = nodes(spark, d)
    report = n.where("node % 5 <> 0").select("clip", "node", F.expr("px + 0.3D * (node % 4)").alias("sx"), F.col("py").alias("sy"), F.col("pz").alias("sz"))
    return scene.apply_settled(n, report, ["clip", "node"]).select("clip", "node", r6(F.col("px")).alias("px"), "settled", "reason")


@query(f"""WITH {NODES}, n AS (SELECT clip, node, grp, ey, py - 0.4::DOUBLE * (node % 7) AS py, {NAMES} AS name FROM nodes), t AS (SELECT clip, max(py + ey / 2) AS top FROM n WHERE grp = 'static' AND lower(name) IN ({GROUND_LIST}) GROUP BY clip),
l AS (SELECT n.*, CASE WHEN grp = 'object' AND top - (py - ey / 2) > 0.01 THEN top - (py - ey / 2) END AS lift FROM n LEFT JOIN t USING (clip)), s AS (SELECT *, CASE WHEN lift <= 2 THEN py + lift ELSE py END AS y FROM l)
SELECT clip, node, round(y, 6) + 0.0::DOUBLE AS py, round(lift, 6) AS lift, coalesce(lift <= 2, false) AS lifted FROM s WHERE NOT (grp = 'object' AND y - ey / 2 < -2 * ey)""")
def p14_settle_on_ground(spark, d):
    n = _named(nodes(spark, d)).drop("class").withColumnRenamed("name", "class").withColumn("py", F.expr("py - 0.4D * (node % 7)"))
    out = scene.drop_sunk(scene.settle_on_ground(n, scene.ground_top(n)))
    return out.select("clip", "node", r6(F.col("py")).alias("py"), r6(F.col("lift")).alias("lift"), F.coalesce("lifted", F.lit(False)).alias("lifted"))


@query("""WITH v AS (SELECT o_orderkey, unnest(range(3)) AS view FROM orders)
SELECT o_orderkey, o_orderkey::VARCHAR || '_v' || view AS name, xor(17::BIGINT, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT) AS seed, round(360 * view / 3::DOUBLE, 6) AS yaw_deg,
  round(('0x' || substr(sha256(o_orderkey::VARCHAR || '/' || view), 1, 8))::BIGINT / 4294967296::DOUBLE, 6) AS uniform FROM v""")
def p15_recamera(spark, d):
    out = scene.recamera(table(spark, d, "orders"), 3, 17, "o_orderkey")
    return out.withColumn("yaw_deg", r6(F.col("yaw_deg"))).withColumn("uniform", r6(F.col("uniform")))


@query(f"""WITH {NODES}, n AS (SELECT *, l.l_partkey AS part FROM nodes JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem) l ON clip = l_orderkey AND node = rn),
s AS (SELECT clip, class, node, ex, quantile_cont(ex, 0.5) OVER (PARTITION BY clip, class) AS median, count(*) OVER (PARTITION BY clip, class) AS peers FROM nodes)
SELECT clip, class, node, round(ex / median, 6) AS ratio FROM s WHERE peers >= 3 AND median > 0 AND (ex / median >= 3 OR ex / median <= 1 / 3::DOUBLE)""")
def d4_size_outliers(spark, d):
    return scene.size_outliers(nodes(spark, d), ["clip", "class"], "ex").select("clip", "class", "node", r6(F.col("ratio")).alias("ratio"))


@query(f"""WITH RECURSIVE {NODES}, s AS (SELECT clip, lower(class) AS class, node, row(node, px, py, pz, sqrt(ex * ex + ey * ey + ez * ez))::STRUCT(node BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, d DOUBLE) AS n,
    row_number() OVER (PARTITION BY clip, lower(class) ORDER BY (px::BIGINT % 7) DESC, pz DESC, node, px, py, pz, ex, ey, ez) AS k FROM nodes WHERE grp = 'object'),
walk AS (SELECT clip, class, k, node, NULL::STRUCT(node BIGINT, rel DOUBLE) AS hit, [n] AS kept FROM s WHERE k = 1
  UNION ALL SELECT clip, class, k, node, hit, CASE WHEN hit IS NULL THEN list_append(kept, n) ELSE kept END FROM (
    SELECT s.*, w.kept, list_filter(list_transform(w.kept, lambda o: row(o.node, CASE WHEN s.n.d > 1e-6 AND o.d > 1e-6 THEN sqrt((o.x - s.n.x) ** 2 + (o.y - s.n.y) ** 2 + (o.z - s.n.z) ** 2) / ((o.d + s.n.d) / 2) END)::STRUCT(node BIGINT, rel DOUBLE)), lambda h: h.rel <= 2)[1] AS hit
    FROM walk w JOIN s ON s.clip = w.clip AND s.class = w.class AND s.k = w.k + 1))
SELECT clip, node, hit.node::VARCHAR AS kept_as, round(hit.rel, 3) AS relative_distance FROM walk""")
def d1_merge_duplicates(spark, d):
    n = nodes(spark, d).where("grp = 'object'").withColumn("frames", (F.col("px") % 7).cast("long")).withColumn("confidence", F.col("pz"))
    return scene.merge_duplicates(n, 2.0).select("clip", "node", F.col("kept_as").cast("string").alias("kept_as"), "relative_distance")


@query(f"""WITH RECURSIVE {NODES}, n AS (SELECT clip, node, px / 10 AS px, py, pz, ex, ey, ez, sqrt(ex * ex + ey * ey + ez * ez) AS d FROM nodes WHERE grp = 'object'),
e AS (SELECT a.clip, a.node AS a, b.node AS b FROM n a JOIN n b ON a.clip = b.clip AND a.node <> b.node WHERE sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2) <= (a.d + b.d) / 2),
r AS (SELECT clip, a, a AS b FROM e UNION SELECT r.clip, r.a, e.b FROM r JOIN e ON e.clip = r.clip AND e.a = r.b),
l AS (SELECT clip, a AS node, min(b) AS component FROM r GROUP BY ALL),
g AS (SELECT clip, component, count(*) AS members, max(px + ex / 2) - min(px - ex / 2) AS bx, max(py + ey / 2) - min(py - ey / 2) AS by_, max(pz + ez / 2) - min(pz - ez / 2) AS bz FROM n JOIN l USING (clip, node) GROUP BY ALL)
SELECT clip, component, members, round(bx, 6) AS bx, round(by_, 6) AS by, round(bz, 6) AS bz FROM g WHERE list_reverse_sort([bx, by_, bz])[1] >= 2 * list_reverse_sort([bx, by_, bz])[2]""")
def d2_fragment_chains(spark, d):
    n = nodes(spark, d).where("grp = 'object'").withColumn("px", F.col("px") / 10)
    return scene.fragment_chains(n, 1.0, 2.0).select("clip", "component", "members", r6(F.col("bx")).alias("bx"), r6(F.col("by")).alias("by"), r6(F.col("bz")).alias("bz"))


@query("""WITH RECURSIVE c AS (SELECT l_suppkey AS clip, floor(l_quantity / 2)::BIGINT AS x, floor(100 * l_discount / 2)::BIGINT AS y, floor(100 * l_tax / 2)::BIGINT AS z, count(*) AS n, sum(l_quantity) AS sx, sum(100 * l_discount) AS sy, sum(100 * l_tax) AS sz FROM lineitem GROUP BY ALL),
i AS (SELECT *, row_number() OVER (ORDER BY clip, x, y, z) AS id FROM c), e AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.clip = b.clip AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.id <> b.id),
r(id, component) USING KEY (id) AS (SELECT id, id FROM i UNION SELECT e.a, min(r.component) FROM r JOIN e ON e.b = r.id JOIN recurring.r AS old ON old.id = e.a WHERE r.component < old.component GROUP BY e.a)
SELECT clip, sum(n)::BIGINT AS points, count(*) AS cells, round(sum(sx) / sum(n), 6) AS x, round(sum(sy) / sum(n), 6) AS y, round(sum(sz) / sum(n), 6) AS z FROM i JOIN r USING (id) GROUP BY clip, component HAVING sum(n) >= 20""")
def d3_voxel_clusters(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_quantity").alias("x"), (100 * F.col("l_discount")).alias("y"), (100 * F.col("l_tax")).alias("z"))
    out = scene.voxel_clusters(li, ["clip"], 2.0, 20)
    return out.select("clip", "points", "cells", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), r6(F.col("z")).alias("z"))


@query(f"""WITH {NODES}, n AS (SELECT clip, class || ((node + 1) // 2) AS node_id, grp, px, py, pz, ex, ey, CASE WHEN node % 6 = 0 THEN 0 ELSE ez END AS ez FROM nodes), r AS (SELECT clip, class || ((node + 1) // 2) AS node_id, 'A' || (node % 3) AS target FROM nodes WHERE node % 4 = 0)
SELECT 'bad_dimensions' AS code, 'error' AS severity, count(*) AS n FROM n WHERE least(ex, ey, ez) <= 0
UNION ALL SELECT 'duplicate_id', 'error', count(*) FROM (SELECT clip, node_id FROM n GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'unknown_reference', 'error', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.clip = r.clip AND n.node_id = r.target)
UNION ALL SELECT 'no_static', 'warning', count(*) FROM (SELECT clip FROM n GROUP BY clip HAVING count(*) FILTER (WHERE grp = 'static') = 0)
UNION ALL SELECT 'support_cycle', 'error', count(*) FROM (WITH RECURSIVE w AS (SELECT clip, node_id, target, 1 AS step FROM r UNION SELECT w.clip, w.node_id, r.target, w.step + 1 FROM w JOIN r ON w.clip = r.clip AND w.target = r.node_id WHERE step < 20) SELECT DISTINCT clip, node_id FROM w WHERE step = 20) HAVING count(*) > 0""")
def v1_validate_programs(spark, d):
    ident = F.concat("class", F.expr("cast((node + 1) div 2 AS string)"))
    n = nodes(spark, d).withColumn("node_id", ident).withColumn("ez", F.expr("CASE WHEN node % 6 = 0 THEN 0 ELSE ez END"))
    refs = nodes(spark, d).where("node % 4 = 0").select("clip", ident.alias("node_id"), F.concat(F.lit("A"), F.expr("cast(node % 3 AS string)")).alias("target"))
    return rules.validate_nodes(n, refs).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NODES}, p AS (SELECT o.clip, o.node, s.node AS support, s.py + s.ey / 2 AS top, o.py - o.ey / 2 AS bottom FROM nodes o JOIN nodes s ON o.clip = s.clip AND o.grp = 'object' AND s.grp = 'static' AND abs(o.px - s.px) * 2 < o.ex + s.ex AND abs(o.pz - s.pz) * 2 < o.ez + s.ez),
b AS (SELECT *, bottom - top AS gap FROM p QUALIFY row_number() OVER (PARTITION BY clip, node ORDER BY top DESC, support) = 1)
SELECT clip, node, support, round(gap, 6) AS gap, CASE WHEN gap < -0.05 THEN 'support_penetration' ELSE 'support_gap' END AS code FROM b WHERE gap < -0.05 OR gap > 0.05""")
def v2_geometry_findings(spark, d):
    return rules.support_findings(nodes(spark, d)).withColumn("gap", r6(F.col("gap")))


@query(f"""WITH {STATES}, o AS (SELECT clip, instance AS object_id, floor(t / 86400)::BIGINT AS frame_index, t, x - 30 AS x1, y AS y1, x + 20 AS x2, y + 5 AS y2, x AS d_min, y AS d_median, 90::DOUBLE AS d_max FROM states),
f AS (SELECT clip, frame_index, min(t) AS t FROM o WHERE frame_index % 5 <> 0 GROUP BY ALL)
SELECT 'bbox_outside_image' AS code, count(*) AS n FROM o WHERE x1 < 0 OR y1 < 0 OR x2 > 110 OR y2 > 100 OR x2 < x1 OR y2 < y1
UNION ALL SELECT 'depth_order', count(*) FROM o WHERE d_min > d_median OR d_median > d_max
UNION ALL SELECT 'repeated_observation', count(*) FROM (SELECT 1 FROM o GROUP BY clip, object_id, frame_index HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'unknown_frame', count(*) FROM o LEFT JOIN f USING (clip, frame_index) WHERE f.t IS NULL
UNION ALL SELECT 'frame_time_mismatch', count(*) FROM o JOIN f USING (clip, frame_index) WHERE abs(o.t - f.t) > 1e-4""")
def v3_validate_evidence(spark, d):
    s = states(spark, d)
    o = s.select("clip", F.col("instance").alias("object_id"), F.floor(F.col("t") / 86400).cast("long").alias("frame_index"), "t", (F.col("x") - 30).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 20).alias("x2"),
                 (F.col("y") + 5).alias("y2"), F.lit(110.0).alias("width"), F.lit(100.0).alias("height"), F.col("x").alias("d_min"), F.col("y").alias("d_median"), F.lit(90.0).alias("d_max"))
    f = o.where("frame_index % 5 <> 0").groupBy("clip", "frame_index").agg(F.min("t").alias("t"))
    return rules.validate_evidence(o, f).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STATES}, f AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY t, event_id) AS frame, t, t + 0.004::DOUBLE * (event_id % 3) AS t_requested, event_id % 10 AS unknown_px FROM states), p AS (SELECT clip, instance AS id, max(floor(y / 15)) AS most FROM states GROUP BY ALL)
SELECT 'time_off' AS code, 'error' AS severity, count(*) AS n FROM f WHERE abs(t - t_requested) > 0.005
UNION ALL SELECT 'unknown_ids', 'error', count(*) FROM f WHERE unknown_px > 0.05 * 100
UNION ALL SELECT 'never_visible', 'warning', count(*) FROM p WHERE most < 4 HAVING count(*) > 0""")
def v5_render_checks(spark, d):
    from pyspark.sql import Window

    s = states(spark, d)
    frames = s.select("clip", F.row_number().over(Window.partitionBy("clip").orderBy("t", "event_id")).alias("frame"), "t", F.expr("t + 0.004D * (event_id % 3)").alias("t_requested"), F.expr("event_id % 10").alias("unknown_px"), F.lit(100).alias("all_px"))
    pixels = s.select("clip", F.lit(0).alias("frame"), F.col("instance").alias("id"), F.floor(F.col("y") / 15).alias("px"))
    return rules.render_checks(frames, pixels).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STATES}, r AS (SELECT DISTINCT clip, floor(t / 172800)::BIGINT AS frame, instance AS id FROM states), dcl AS (SELECT DISTINCT clip, instance AS id FROM states WHERE (clip + length(instance)) % 6 <> 0), e AS (SELECT clip, floor((max(t) - min(t)) / 172800 + 0.5)::BIGINT + CASE WHEN abs(floor((max(t) - min(t)) / 172800 + 0.5) / (1 / 172800::DOUBLE) - (max(t) - min(t))) > 1e-9 THEN 1 ELSE 0 END AS frames FROM states GROUP BY clip),
fr AS (SELECT DISTINCT clip, frame FROM r), m AS (SELECT fr.clip, count(*) AS missing FROM fr JOIN dcl USING (clip) LEFT JOIN r ON r.clip = fr.clip AND r.frame = fr.frame AND r.id = dcl.id WHERE r.id IS NULL GROUP BY fr.clip),
x AS (SELECT r.clip, count(*) AS extra FROM r LEFT JOIN dcl USING (clip, id) WHERE dcl.clip IS NULL GROUP BY r.clip), s AS (SELECT clip, count(*) AS seen FROM fr GROUP BY clip)
SELECT e.clip, frames, coalesce(seen, 0) AS frames_seen, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, frames = coalesce(seen, 0) AND coalesce(missing, 0) = 0 AND coalesce(extra, 0) = 0 AS ok FROM e LEFT JOIN s USING (clip) LEFT JOIN m USING (clip) LEFT JOIN x USING (clip)""")
def v6_integrity_check(spark, d):
    s = states(spark, d)
    r = s.select("clip", F.floor(F.col("t") / 172800).cast("long").alias("frame"), F.col("instance").alias("id")).distinct()
    declared = s.where("(clip + length(instance)) % 6 <> 0").select("clip", F.col("instance").alias("id")).distinct()
    expected = s.groupBy("clip").agg((F.max("t") - F.min("t")).alias("d")).select("clip", rules.expected_frames(F.col("d"), F.lit(1 / 172800)).alias("frames"))
    return rules.integrity(r, declared, expected)


@query("""WITH t AS (SELECT c_custkey AS truth, c_custkey % 1200 AS name, c_nationkey * 100 AS alias FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT o_orderkey AS run, o_custkey AS clip FROM orders),
n AS (SELECT name, count(*) AS n, min(truth) AS t FROM t GROUP BY name), a AS (SELECT alias, count(*) AS m, min(truth) AS u FROM t GROUP BY alias)
SELECT run, clip, CASE WHEN n = 1 THEN 'by_name' WHEN n > 1 THEN 'ambiguous' WHEN m = 1 THEN 'by_alias' WHEN m > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, CASE WHEN n = 1 THEN t WHEN n IS NULL AND m = 1 THEN u END::VARCHAR AS truth FROM r LEFT JOIN n ON n.name = clip LEFT JOIN a ON a.alias = clip""")
def v7_resolve_truth(spark, d):
    truths = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("truth"), F.expr("c_custkey % 1200").alias("name"), F.expr("cast(c_nationkey * 100 AS bigint)").alias("alias"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("clip"))
    return rules.resolve_truth(runs, truths, "clip").withColumn("truth", F.col("truth").cast("string"))


@query(f"""WITH {PREDICTIONS}, b AS (SELECT clip AS key, '/' || node || '/' || f AS path, CASE f WHEN 'px' THEN px ELSE pz END AS v FROM nodes, (SELECT unnest(['px', 'pz']) AS f)), a AS (SELECT clip AS key, '/' || node || '/' || f AS path, CASE f WHEN 'px' THEN px ELSE pz END AS v FROM predictions, (SELECT unnest(['px', 'pz']) AS f)),
j AS (SELECT key, path, b.v AS b, a.v AS a FROM b FULL JOIN a USING (key, path))
SELECT key, count(*) FILTER (WHERE NOT coalesce(abs(a - b) <= 1e-6, a IS NULL AND b IS NULL)) AS changed, count(*) FILTER (WHERE NOT coalesce(abs(a - b) <= 1e-6, a IS NULL AND b IS NULL)) AS wrong, count(*) FILTER (WHERE NOT coalesce(abs(a - b) <= 1e-6, a IS NULL AND b IS NULL)) = 0 AS passed FROM j GROUP BY key""")
def v9_edit_judgement(spark, d):
    def leaves(df):
        fields = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in ("px", "pz")])
        return df.select(F.col("clip").alias("key"), "node", F.explode(fields).alias("x")).select("key", F.concat_ws("/", F.lit(""), F.col("node").cast("string"), "x.f").alias("path"), F.col("x.v").cast("string").alias("value"))

    before = leaves(nodes(spark, d))
    return rules.edit_judgement(before, leaves(predictions(spark, d)), before)


@query(f"""WITH {STATES}, p AS (SELECT clip, -quantile_cont(y, 0.5) AS o FROM states GROUP BY clip), c AS (SELECT clip, instance, min(t) AS a, (min(t) + max(t)) / 2 AS b FROM states WHERE clip % 2 = 0 GROUP BY ALL),
g AS (SELECT s.clip, s.instance, s.t, y - 5 + o AS gap, c.clip IS NOT NULL AS claimed FROM states s JOIN p USING (clip) LEFT JOIN c ON c.clip = s.clip AND c.instance = s.instance AND s.t >= c.a AND s.t <= c.b)
SELECT clip, instance, count(*) AS n, count(*) FILTER (WHERE gap < -20) AS below, count(*) FILTER (WHERE claimed AND abs(gap) > 20) AS contradicted FROM g GROUP BY ALL""")
def v10_geometry_audit(spark, d):
    s = states(spark, d)
    planes = s.groupBy("clip").agg((-F.percentile("y", F.lit(0.5))).alias("offset"))
    contacts = s.where("clip % 2 = 0").groupBy("clip", F.col("instance").alias("object_id")).agg(F.min("t").alias("t_start"), ((F.min("t") + F.max("t")) / 2).alias("t_end"))
    boxes = s.select("clip", F.col("instance").alias("object_id"), "t", F.col("y").alias("py"), F.lit(10.0).alias("ey"))
    out = rules.geometry_audit(boxes, planes, contacts, 20.0)
    return out.groupBy("clip", F.col("object_id").alias("instance")).agg(F.count(F.lit(1)).alias("n"), F.count_if("below").alias("below"), F.count_if("contradicted").alias("contradicted"))


TURNED = f"""{NODES}, n AS (SELECT *, {NAMES} AS name, sin(0.2::DOUBLE * (node % 8)) AS qx, cos(0.2::DOUBLE * (node % 8)) AS qw FROM nodes), v AS (SELECT *, 0::DOUBLE AS v0, abs(1 - 2 * (qx * qx)) AS v1, abs(-2 * (qw * qx)) AS v2 FROM n)"""


@query(f"""WITH {TURNED}, g AS (SELECT clip, arg_max(py + ey / 2, row(ex * ez, -node)) AS level FROM n WHERE grp = 'static' GROUP BY clip),
s AS (SELECT v.*, coalesce(level, 0) AS level, (ey * ez * v0 >= 0.45 AND v0 >= 0.573576436351046) OR (ex * ez * v1 >= 0.45 AND v1 >= 0.573576436351046) OR (ex * ey * v2 >= 0.45 AND v2 >= 0.573576436351046) AS stand FROM v LEFT JOIN g USING (clip))
SELECT role, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(name), 'lava|spike|water|fire|acid') THEN 'hazard' WHEN grp = 'static' THEN 'static_structure' WHEN stand AND node % 2 = 0 THEN 'dynamic_platform' WHEN stand THEN 'platform'
  WHEN greatest(ex, ey, ez) <= 1.4 AND list_sort([ex, ey, ez])[2] / greatest(ex, ey, ez) >= 0.3 AND py - level <= 2.7 THEN 'collectible' WHEN node % 2 = 0 AND py - level <= 2.7 THEN 'moving_obstacle' ELSE 'decoration' END AS role FROM s) GROUP BY role""")
def p12_affordance_turned(spark, d):
    n = _named(nodes(spark, d)).drop("class").withColumnRenamed("name", "class").withColumns({"qx": F.expr("sin(0.2D * (node % 8))"), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.expr("cos(0.2D * (node % 8))")})
    return scene.affordance(n, scene.ground_level(n), F.col("node") % 2 == 0).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NODES}, s AS (SELECT clip, greatest(max(px + ex / 2) - min(px - ex / 2), max(pz + ez / 2) - min(pz - ez / 2)) AS footprint FROM nodes GROUP BY clip)
SELECT clip, round(footprint, 6) AS footprint, round(CASE WHEN abs(24 / footprint - 1) <= 0.05 THEN 1 ELSE 24 / footprint END, 6) AS k FROM s WHERE footprint > 0""")
def p10_footprint_factor(spark, d):
    return scene.footprint_factor(nodes(spark, d)).select("clip", r6(F.col("footprint")).alias("footprint"), r6(F.col("k")).alias("k"))

"""Retrieval and geometry over parts, embeddings, documents and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions.columns import r6
from sceneloom.operators import geometry as G
from sceneloom.operators import motion_fit
from sceneloom.operators import retrieval as R
from sceneloom.plans.adapters import NODES, STATES, nodes, states, table
from sceneloom.plans.registry import query
from sceneloom.shared import stored

STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP) + "]"
STYLE = "[" + ", ".join(f"'{w}'" for w in R.STYLE) + "]"


def _tokens(text: str) -> str:
    """SQL of the tokens; RE2 has no lookaround, so the split places are captured and put back."""
    spaced = f"regexp_replace(regexp_replace(coalesce({text}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({spaced}, '[^A-Za-z0-9]+'), lambda t: lower(t)), lambda t: t <> '' AND NOT list_contains({STOP}, t))"


ASSETS = f"assets AS (SELECT p_partkey AS asset_id, p_name AS name, p_brand AS kit, p_type AS kit_title, list_distinct({_tokens('p_name')}) AS name_words, list_distinct(list_concat({_tokens('p_type')}, {_tokens('p_brand')})) AS kit_words FROM part)"


def _assets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kit"), F.col("p_type").alias("kit_title"))


QUERY_SQL = "queries AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' ELSE 'toy ' || lower(p_type) END AS query FROM part)"


def _queries(spark, d):
    return table(spark, d, "part").select(F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, 's') ELSE concat('toy ', lower(p_type)) END").alias("query")).distinct()


SYNONYMS = "syn AS (SELECT unnest([" + ", ".join(f"'{a}'" for a, _ in R.SYNONYMS) + "]) AS token, unnest([" + ", ".join(f"'{b}'" for _, b in R.SYNONYMS) + "]) AS word)"
SCORES = f"""{ASSETS}, {QUERY_SQL}, {SYNONYMS}, q AS (SELECT query, {_tokens('query')} AS tokens FROM queries), w AS (SELECT query, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM q),
forms AS (SELECT query, pos, token, token || 's' AS word FROM w UNION SELECT query, pos, token, token || 'es' FROM w UNION SELECT query, pos, token, regexp_replace(token, 'es$', '') FROM w WHERE length(token) > 3 AND ends_with(token, 'es')
  UNION SELECT query, pos, token, regexp_replace(token, 's$', '') FROM w WHERE length(token) > 2 AND ends_with(token, 's') UNION SELECT query, pos, w.token, syn.word FROM w JOIN syn ON w.token = syn.token),
asks AS (SELECT query, pos, token AS word, true AS exact FROM w UNION ALL SELECT query, pos, word, false FROM forms WHERE word <> token), idx AS (SELECT asset_id, unnest(name_words) AS word, true AS in_name FROM assets UNION ALL SELECT asset_id, unnest(kit_words), false FROM assets),
per AS (SELECT query, asset_id, pos, max(CASE WHEN in_name THEN CASE WHEN exact THEN 1 ELSE 0.85 END ELSE CASE WHEN exact THEN 0.4 ELSE 0.34 END END::DOUBLE) AS w, bool_or(in_name) AS in_name FROM asks JOIN idx USING (word) GROUP BY ALL),
s AS (SELECT query, asset_id, sum(w) AS hit, count(*) FILTER (WHERE in_name) AS in_name FROM per GROUP BY ALL),
scored AS (SELECT query, asset_id, round(least(hit / len(tokens) / (1 + 0.12::DOUBLE * greatest(len(list_filter(name_words, lambda t: NOT list_contains({STYLE}, t) AND NOT regexp_full_match(t, '[0-9]+'))) - s.in_name, 0)) * CASE WHEN list_contains(tokens, kit) THEN 1.25 ELSE 1 END, 1), 4) AS score FROM s JOIN q USING (query) JOIN assets USING (asset_id))"""


@query(f"WITH {ASSETS} SELECT asset_id, array_to_string(list_sort(name_words), ' ') AS name_words, array_to_string(list_sort(kit_words), ' ') AS kit_words FROM assets")
def r1_tokenize(spark, d):
    a = _assets(spark, d)
    kit = F.array_distinct(F.concat(R.tokenize(F.col("kit_title")), R.tokenize(F.col("kit"))))
    return a.select("asset_id", F.array_join(F.array_sort(F.array_distinct(R.tokenize(F.col("name")))), " ").alias("name_words"), F.array_join(F.array_sort(kit), " ").alias("kit_words"))


@query(f"WITH {SCORES} SELECT query, asset_id, score FROM scored WHERE score > 0")
def r2_score_assets(spark, d):
    return R.score_assets(_queries(spark, d), _assets(spark, d))


UNIT = "list_transform({0}, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"


@query(f"""WITH u AS (SELECT vec_id, label, {UNIT.format('embedding')} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v FROM u WHERE vec_id % 100 = 0)
SELECT query_id, label::BIGINT AS asset_id, round(max(greatest(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 0)), 4) AS score FROM q, u GROUP BY ALL""")
def r3_view_scores(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))  # the stated query set, against all rows
    views = e.select(F.col("label").cast("long").alias("asset_id"), F.col("vec_id").alias("view_id"), F.col("embedding").alias("vec"))
    return R.view_scores(queries, views)


IMAGES = "images AS (SELECT query, asset_id, ((asset_id * 7 + length(query)) % 11) / 11::DOUBLE AS image FROM scored)"


def _images(scored):
    return scored.select("query", "asset_id", F.expr("((asset_id * 7 + length(query)) % 11) / 11D").alias("image"))


RETRIEVED = f"""{SCORES}, {IMAGES}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, asset_id) AS r FROM scored WHERE score > 0),
b AS (SELECT t.*, (1 - 0.5::DOUBLE) * score + 0.5::DOUBLE * image AS blend FROM t JOIN images USING (query, asset_id)),
ranked AS (SELECT query, asset_id, score, row_number() OVER (PARTITION BY query ORDER BY (r > 24)::INT, CASE WHEN r <= 24 THEN -blend ELSE r END, asset_id) AS rank FROM b)"""


@query(f"WITH {RETRIEVED} SELECT query, asset_id, score, rank FROM ranked WHERE rank <= 5")
def r4_retrieve(spark, d):
    s = stored(R.top_assets(_queries(spark, d), _assets(spark, d), 24), "shortlists")
    return R.retrieve(s, _images(s), 5)


def _ranked(spark, d, k):
    return R.retrieve(R.top_assets(_queries(spark, d), _assets(spark, d), k), None, k)


TEXT_RANKED = f"{SCORES}, ranked AS (SELECT query, asset_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, asset_id) AS rank FROM scored WHERE score > 0)"
SHAPES = "shapes AS (SELECT p_partkey AS asset_id, [1.0::DOUBLE, (p_size % 10 + 1) / 11::DOUBLE, (p_size % 7 + 1) / 77::DOUBLE] AS s FROM part)"


@query(f"""WITH {TEXT_RANKED}, {SHAPES}, h AS (SELECT * FROM ranked WHERE rank <= 10), o AS (SELECT query, [1.0::DOUBLE, (length(query) % 5 + 1) / 6::DOUBLE, 0.1::DOUBLE] AS o FROM queries WHERE length(query) % 4 <> 0),
j AS (SELECT query, asset_id, score, o, (abs(o[1] - s[1]) + abs(o[2] - s[2]) + abs(o[3] - s[3])) / 3 AS far, count(*) OVER (PARTITION BY query) AS n, max(score) OVER (PARTITION BY query) AS best FROM h LEFT JOIN o USING (query) LEFT JOIN shapes USING (asset_id)),
b AS (SELECT query, asset_id, score, round(CASE WHEN n >= 2 AND o IS NOT NULL THEN (1 - 0.5::DOUBLE) * score / best + 0.5::DOUBLE * (1 - coalesce(far, 1)) ELSE score END, 6) AS blend FROM j)
SELECT query, asset_id, score, blend, row_number() OVER (PARTITION BY query ORDER BY blend DESC, asset_id) AS rank FROM b""")
def r5_shape_rerank(spark, d):
    hits = _ranked(spark, d, 10).drop("rank")
    observed = _queries(spark, d).where("length(query) % 4 <> 0").select("query", F.array(F.lit(1.0), F.expr("(length(query) % 5 + 1) / 6D"), F.lit(0.1)).alias("ratios"))
    shapes = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.array(F.lit(1.0), F.expr("(p_size % 10 + 1) / 11D"), F.expr("(p_size % 7 + 1) / 77D")).alias("ratios"))
    return R.shape_rerank(hits, observed, shapes)


@query(f"WITH {TEXT_RANKED} SELECT query, CASE WHEN min_by(score, rank) >= 0.45 THEN min_by(asset_id, rank)::VARCHAR END AS chosen, min_by(score, rank) AS score, least(count(*), 5) AS candidates, CASE WHEN min_by(score, rank) >= 0.45 THEN 'accepted' ELSE 'below_threshold' END AS reason FROM ranked GROUP BY query")
def r6_choose_assets(spark, d):
    return R.choose_assets(_ranked(spark, d, 5))


@query("""WITH b AS (SELECT l_suppkey, list_reverse_sort([max(l_quantity) - min(l_quantity), 100 * (max(l_discount) - min(l_discount)), 100 * (max(l_tax) - min(l_tax))]) AS e FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 20)
SELECT l_suppkey, round(e[1] / e[1], 4) AS a, round(e[2] / e[1], 4) AS b, round(e[3] / e[1], 4) AS c FROM b WHERE e[1] > 0""")
def r7_asset_edge_ratios(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (100 * F.col("l_discount")).alias("y"), (100 * F.col("l_tax")).alias("z"))
    # the box is scaled after it is taken, as in the SQL
    return R.asset_edge_ratios(li, "l_suppkey").select("l_suppkey", *[F.col("ratios")[i].alias(c) for i, c in enumerate("abc")])


@query(f"""WITH u AS (SELECT vec_id, label, {UNIT.format('embedding')} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), q AS (SELECT label AS query_id, v FROM u WHERE n = 1),
s AS (SELECT query_id, label AS asset_id, round(max(greatest(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 0)), 4) AS score FROM q, u WHERE n > 1 GROUP BY ALL), o AS (SELECT query_id, score AS own FROM s WHERE query_id = asset_id)
SELECT query_id::BIGINT AS query_id, count(*) FILTER (WHERE score > own) + 1 AS rank, max(own) AS own FROM s JOIN o USING (query_id) GROUP BY query_id""")
def r8_leave_one_view_out(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("asset_id"), F.col("vec_id").alias("view_id"), F.col("embedding").alias("vec"))
    return R.leave_one_view_out(e)


@query(f"""WITH u AS (SELECT vec_id, label, {UNIT.format('embedding')} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), q AS (SELECT label AS query_id, v FROM u WHERE n = 1),
s AS (SELECT query_id, label AS asset_id, round(max(greatest(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 0)), 4) AS score FROM q, u WHERE n > 1 GROUP BY ALL), o AS (SELECT query_id, score AS own FROM s WHERE query_id = asset_id),
r AS (SELECT query_id, count(*) FILTER (WHERE score > own) + 1 AS rank FROM s JOIN o USING (query_id) GROUP BY query_id)
SELECT count(*) AS assets, quantile_cont(rank, 0.25) AS q1, quantile_cont(rank, 0.5) AS median, quantile_cont(rank, 0.75) AS q3, round(avg((rank <= 1)::INT), 6) AS top1, round(avg((rank <= 64)::INT), 6) AS top64 FROM r""")
def r8_self_match(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("asset_id"), F.col("vec_id").alias("view_id"), F.col("embedding").alias("vec"))
    return R.self_match(R.leave_one_view_out(e)).withColumns({"top1": r6(F.col("top1")), "top64": r6(F.col("top64"))})


@query(f"""WITH {TEXT_RANKED}, t AS (SELECT query, p_partkey AS asset_id FROM queries JOIN part ON p_size = length(query) % 50), b AS (SELECT query, min(rank) AS best FROM ranked SEMI JOIN t USING (query, asset_id) GROUP BY query),
k AS (SELECT query, best, k FROM queries LEFT JOIN b USING (query), (SELECT unnest([1, 16, 64, 256]) AS k)) SELECT k, round(avg(coalesce((best <= k)::INT, 0)), 6) AS coverage, count(*) AS n FROM k GROUP BY k""")
def r9_coverage_at_k(spark, d):
    q = _queries(spark, d)
    truths = q.join(table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_size")), F.expr("p_size = length(query) % 50")).select("query", "asset_id")
    best = R.best_truth_rank(_ranked(spark, d, 1_000_000), truths, ["query"])
    return R.coverage_at(q.join(best, "query", "left"), [1, 16, 64, 256]).withColumn("coverage", r6(F.col("coverage")))


@query(f"""WITH {TEXT_RANKED}, c AS (SELECT query, asset_id AS chosen FROM ranked WHERE rank = 1), j AS (SELECT query, a.name AS name, a.kit AS kit, (SELECT count(*) FROM assets t WHERE t.name = query) AS exists_exact FROM c JOIN assets a ON a.asset_id = chosen)
SELECT count(*) AS n, round(avg((name = query)::INT), 6) AS exact, round(avg((exists_exact > 0)::INT), 6) AS ceiling FROM j""")
def r10_retrieval_hit_rates(spark, d):
    a = _assets(spark, d).select("asset_id", "name")
    names = a.select(F.col("name").alias("query")).distinct().withColumn("has", F.lit(1.0))
    j = _ranked(spark, d, 1).join(a, "asset_id").join(names, "query", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("name") == F.col("query")).cast("double"))).alias("exact"), r6(F.avg(F.coalesce("has", F.lit(0.0)))).alias("ceiling"))


@query("""WITH s AS (SELECT doc_id, quality AS hit, n_chars AS score, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM labels JOIN documents USING (doc_id)), b AS (SELECT ((rn * 4 + n - 1) // n - 1)::INT AS bin, hit FROM s), g AS (SELECT bin, count(*) AS n, sum(hit)::BIGINT AS hits FROM b GROUP BY bin)
SELECT bin, n, hits, round(hits / n, 6) AS rate, round(hits / n / (sum(hits) OVER () / sum(n) OVER ()), 6) AS lift FROM g""")
def r11_hit_rate_by_score_bins(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id").withColumn("hit", F.col("quality"))
    out = R.hit_rate_by_bins(j, "score", "hit", ["doc_id"])
    return out.withColumn("rate", r6(F.col("rate"))).withColumn("lift", r6(F.col("lift")))


@query(f"""WITH {TEXT_RANKED}, v AS (SELECT length(query) % 7 AS clip, query AS patch, min_by(name, rank) AS phrase FROM ranked JOIN assets USING (asset_id) WHERE rank <= 5 AND len({_tokens('name')}) >= 2 GROUP BY query), c AS (SELECT clip, phrase, count(*) AS votes FROM v GROUP BY ALL)
SELECT clip, phrase, votes, row_number() OVER (PARTITION BY clip ORDER BY votes DESC, phrase) AS place FROM c QUALIFY place <= 8""")
def r12_phrase_votes(spark, d):
    ranked = _ranked(spark, d, 5).withColumn("clip", (F.length("query") % 7).cast("long")).withColumnRenamed("query", "patch")
    return R.phrase_votes(ranked, _assets(spark, d).select("asset_id", F.col("name").alias("phrase")), "clip", "patch")


@query(f"WITH {TEXT_RANKED} SELECT round(avg(list_has_any({_tokens('query')}, {_tokens('name')})::INT), 6) AS agreement, count(*) AS n FROM ranked JOIN assets USING (asset_id) WHERE rank = 1")
def r13_name_agreement(spark, d):
    j = _ranked(spark, d, 1).join(_assets(spark, d), "asset_id")
    return R.name_agreement(j, "query", "name").withColumn("agreement", r6(F.col("agreement")))


@query(f"""WITH u AS (SELECT label, vec_id, {UNIT.format('embedding')} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings), r AS (SELECT a.label, a.i, a.v AS a, list_reverse(a.v) AS b, p.v AS p, f.v AS f FROM u a LEFT JOIN u p ON p.label = a.label AND p.i = a.i - 1 LEFT JOIN u f ON f.label = a.label AND f.i = a.i - floor(a.n / 2)),
s AS (SELECT label, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) AS ab, list_sum(list_transform(list_zip(a, p), lambda p: p[1] * p[2])) AS ap, list_sum(list_transform(list_zip(a, f), lambda p: p[1] * p[2])) AS af FROM r)
SELECT label, round(quantile_cont(ab, 0.5), 5) AS paired, round(quantile_cont(ap, 0.5), 5) AS self, round(quantile_cont(af, 0.5), 5) AS floor FROM s GROUP BY label""")
def r14_likeness(spark, d):
    e = table(spark, d, "embeddings").withColumn("other", F.reverse("embedding"))
    return R.likeness(e, "label", "vec_id", "embedding", "other").select("label", *[F.round(c, 5).alias(c) for c in ("paired", "self", "floor")])


POINTS = "pts AS (SELECT l_suppkey AS clip, l_quantity AS x, 100 * l_discount AS y, 100 * l_tax + l_quantity / 2 AS z FROM lineitem)"


def _points(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_quantity").alias("x"), (100 * F.col("l_discount")).alias("y"), (100 * F.col("l_tax") + F.col("l_quantity") / 2).alias("z"))


@query(f"""WITH {STATES}, cam AS (SELECT clip, avg(x) / 100 AS yaw, min(x) AS tx, max(y) AS tz FROM states GROUP BY clip)
SELECT clip, event_id, round(cos(yaw) * (x - 50) / 80 * (y / 10) + sin(yaw) * (-(y / 10)) + tx, 6) + 0.0::DOUBLE AS x, round(-(y - 40) / 80 * (y / 10) + 1.5, 6) + 0.0::DOUBLE AS y FROM states JOIN cam USING (clip) WHERE y / 10 > 1e-4""")
def g1_unproject(spark, d):
    s = states(spark, d)
    cams = s.groupBy("clip").agg((F.avg("x") / 100).alias("yaw"), F.min("x").alias("tx"), F.max("y").alias("tz")).withColumns({"fx": F.lit(80.0), "fy": F.lit(80.0), "cx": F.lit(50.0), "cy": F.lit(40.0), "ty": F.lit(1.5)})
    px = s.select("clip", F.col("x").alias("u"), F.col("y").alias("v"), (F.col("y") / 10).alias("depth"))
    ids = s.select("clip", F.col("x").alias("u"), F.col("y").alias("v"), "event_id")
    out = G.unproject(px.join(ids, ["clip", "u", "v"]).select("clip", "u", "v", "depth", "event_id").drop("event_id").distinct(), cams, ["clip"])
    return out.join(ids, ["clip", "u", "v"]).select("clip", "event_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"""WITH {POINTS}, m AS (SELECT clip, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM pts GROUP BY clip HAVING count(*) >= 20), f AS (SELECT pts.*, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS d FROM pts JOIN m USING (clip)),
l AS (SELECT clip, quantile_cont(d, 0.9) * 1.5 + 1e-6 AS lim FROM f GROUP BY clip), k AS (SELECT f.* FROM f JOIN l USING (clip) WHERE d < lim), s AS (SELECT clip, count(*) AS points, avg(x) AS cx, avg(z) AS cz, 0.5 * atan2(2 * covar_samp(x, z), var_samp(x) - var_samp(z)) AS yaw FROM k GROUP BY clip HAVING count(*) >= 20),
q AS (SELECT clip, points, yaw, cos(yaw) * (x - cx) + sin(yaw) * (z - cz) AS a, y FROM k JOIN s USING (clip))
SELECT clip, any_value(points) AS points, round(any_value(yaw), 5) AS yaw, round(greatest(quantile_cont(a, 0.97) - quantile_cont(a, 0.03), 0.02), 5) AS ex, round(greatest(quantile_cont(y, 0.97) - quantile_cont(y, 0.03), 0.02), 5) AS ey FROM q GROUP BY clip""")
def g2_oriented_boxes(spark, d):
    out = G.oriented_boxes(_points(spark, d), ["clip"])
    return out.select("clip", "points", *[F.round(c, 5).alias(c) for c in ("yaw", "ex", "ey")])


@query(None)
def g3_plane_candidates(spark, d):
    p = _points(spark, d).select("clip", "x", (F.col("y") / 10).alias("y"), "z")
    return G.plane_candidates(p, "clip").select("clip", "idx", "inliers", r6(F.col("angle_deg")).alias("angle_deg"))


PLANES = f"{NODES}, cand AS (SELECT clip, node AS idx, px::BIGINT AS inliers, px * 1.2 AS angle_deg, px AS angle_to_view_deg, py - 0.3 AS cam_height, pz AS frac FROM nodes)"


@query(f"""WITH {PLANES}, u AS (SELECT *, angle_deg < 50 AND cam_height > 0 AND frac >= 0.5 AS up, angle_to_view_deg < 35 AND frac >= 0.3 AS facing FROM cand), o AS (SELECT *, bool_or(up) OVER (PARTITION BY clip) AS anyup FROM u),
k AS (SELECT * REPLACE (CASE WHEN anyup THEN cam_height ELSE abs(cam_height) END AS cam_height) FROM o WHERE CASE WHEN anyup THEN up ELSE facing END), m AS (SELECT *, cam_height >= 0.25 * quantile_cont(cam_height, 0.5) OVER (PARTITION BY clip) AS far FROM k), a AS (SELECT *, bool_or(far) OVER (PARTITION BY clip) AS anyfar FROM m),
b AS (SELECT *, inliers * (0.5 + 0.5 * frac) AS score FROM a WHERE far OR NOT anyfar QUALIFY row_number() OVER (PARTITION BY clip ORDER BY score DESC, idx) = 1)
SELECT clip, idx, round(score, 6) AS score, CASE WHEN anyup THEN 'upright' ELSE 'facing_camera' END AS mode, round(CASE WHEN cam_height > 1e-3 THEN 1.2 / cam_height ELSE 1 END, 6) AS scale FROM b""")
def g3_choose_ground(spark, d):
    c = nodes(spark, d).select("clip", F.col("node").alias("idx"), F.col("px").cast("long").alias("inliers"), (F.col("px") * 1.2).alias("angle_deg"), F.col("px").alias("angle_to_view_deg"), (F.col("py") - 0.3).alias("cam_height"), F.col("pz").alias("frac_obj_above"))
    return G.choose_ground(c, "clip").withColumn("score", r6(F.col("score"))).withColumn("scale", r6(F.col("scale")))


@query(None)
def g4_estimate_motion(spark, d):
    half = F.radians(F.col("y") / 4)
    s = states(spark, d).select("clip", "instance", (F.col("t") / 100_000).alias("t"), (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"), F.lit(0.0).alias("z"),
                                F.lit(0.0).alias("qx"), F.sin(half).alias("qy"), F.lit(0.0).alias("qz"), F.cos(half).alias("qw"), (F.col("x") / 50).alias("visible"))
    out = motion_fit.estimate_motion(s, ["clip", "instance"])
    return out.withColumn("candidates", F.concat_ws(",", F.transform("candidates", lambda c: F.concat_ws(":", c["motion"], c["score"].cast("string"))))).drop("axis", "pivot")


@query(f"""WITH {STATES}, st AS (SELECT clip, instance, x / 2000 AS step_m, y / 20 AS step_deg, x, y, x / 100 AS travel FROM states), m AS (SELECT clip, instance, quantile_cont(step_m / 1.0::DOUBLE, 0.5) AS rel, quantile_cont(step_deg, 0.5) AS deg, sum(step_deg) AS turned, sum(step_m) AS path, max(travel) AS travel,
  avg(x / greatest(sqrt(x * x + y * y + 0.25), 1e-12)) AS ax, avg(y / greatest(sqrt(x * x + y * y + 0.25), 1e-12)) AS ay, avg(0.5 / greatest(sqrt(x * x + y * y + 0.25), 1e-12)) AS az FROM st GROUP BY ALL)
SELECT clip, instance, CASE WHEN rel <= 0.02 AND deg <= 1.5 THEN 'static' WHEN turned >= 8 AND sqrt(ax * ax + ay * ay + az * az) >= 0.85 THEN 'hinge' WHEN travel >= 0.05 AND travel / greatest(path, 1e-9) >= 0.9 THEN 'slide' ELSE 'none' END AS joint, round(sqrt(ax * ax + ay * ay + az * az), 6) AS axis_consistency FROM m""")
def g5_infer_articulation(spark, d):
    s = states(spark, d).select("clip", "instance", (F.col("x") / 2000).alias("step_m"), (F.col("y") / 20).alias("step_deg"), F.col("x").alias("axis_x"), F.col("y").alias("axis_y"), F.lit(0.5).alias("axis_z"), (F.col("x") / 100).alias("travel_m"), F.lit(1.0).alias("diag"))
    return G.infer_articulation(s, ["clip", "instance"]).select("clip", "instance", "joint", r6(F.col("axis_consistency")).alias("axis_consistency"))


@query(None)
def g6_fit_shape_kind(spark, d):
    return G.fit_shape_kind(_points(spark, d), ["clip"]).withColumn("residual", r6(F.col("residual")))


@query(f"""WITH {NODES}, n AS (SELECT clip, node, ['car', 'toy car', 'table lamp', 'tree', 'crate'][((clip + node) % 5 + 1)::INT] AS name, ex AS longest FROM nodes), pr AS (SELECT unnest(['car', 'lamp', 'table', 'tree']) AS word, unnest([4.0, 0.4, 0.8, 3.0]::DOUBLE[]) AS size),
w AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS word FROM n), b AS (SELECT name, size FROM w JOIN pr USING (word) QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(word) DESC, word) = 1),
j AS (SELECT clip, size / longest AS r, size >= 0.5 AS anchor FROM n JOIN b USING (name) WHERE longest > 1e-6), g AS (SELECT clip, count(*) AS known, count(*) FILTER (WHERE anchor) AS anchors, quantile_cont(CASE WHEN anchor THEN r END, 0.5) AS a, quantile_cont(r, 0.5) AS m FROM j GROUP BY clip),
f AS (SELECT *, CASE WHEN anchors >= 2 THEN a ELSE m END AS fac FROM g) SELECT clip, known, anchors, round(CASE WHEN known >= 2 AND fac BETWEEN 0.05 AND 20 THEN fac ELSE 1 END, 6) AS factor FROM f""")
def g7_metric_scale(spark, d):
    names = F.array(*[F.lit(x) for x in ("car", "toy car", "table lamp", "tree", "crate")])[F.expr("cast((clip + node) % 5 AS int)")]
    o = nodes(spark, d).select("clip", "node", names.alias("name"), F.col("ex").alias("longest"))
    priors = spark.createDataFrame([("car", 4.0), ("lamp", 0.4), ("table", 0.8), ("tree", 3.0)], "word string, size double")
    return G.metric_scale(o, priors, "clip").withColumn("factor", r6(F.col("factor")))


@query(f"""WITH {STATES}, p AS (SELECT clip, instance, floor(t / 172800)::BIGINT AS frame, y AS r, x AS g, (x + y) / 2 AS b FROM states), f AS (SELECT clip, frame, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM p GROUP BY ALL HAVING count(*) >= 4), c AS (SELECT clip, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b, count(*) AS frames FROM f GROUP BY clip)
SELECT clip, frames, '#' || lpad(lower(hex(floor(r + 0.5)::BIGINT)), 2, '0') || lpad(lower(hex(floor(g + 0.5)::BIGINT)), 2, '0') || lpad(lower(hex(floor(b + 0.5)::BIGINT)), 2, '0') AS hex FROM c""")
def g8_observed_colour(spark, d):
    p = states(spark, d).select("clip", F.floor(F.col("t") / 172800).cast("long").alias("frame"), F.col("y").alias("r"), F.col("x").alias("g"), F.expr("(x + y) / 2").alias("b"))
    return G.observed_colour(p, ["clip"], "frame").select("clip", "frames", "hex")


@query(f"""WITH {STATES}, p AS (SELECT clip, instance, x AS r, y AS g, x + y AS b, x + 10 AS orr, y + 20 AS og, x + y + 5 AS ob FROM states), q AS (SELECT clip, instance, quantile_cont((abs(r - orr) + abs(g - og) + abs(b - ob)) / 3, 0.5) AS error, quantile_cont((0.2126 * r + 0.7152 * g + 0.0722 * b) / greatest(0.2126 * orr + 0.7152 * og + 0.0722 * ob, 1e-6), 0.5) AS ratio FROM p GROUP BY ALL)
SELECT clip, instance, round(error, 6) AS error, round(ratio, 6) AS luma_ratio, round(least(greatest(1 + 0.5 * (1 / ratio - 1), 0.25), 4), 6) AS gain FROM q""")
def g9_colour_residual(spark, d):
    p = states(spark, d).select("clip", "instance", F.col("x").alias("r"), F.col("y").alias("g"), F.expr("x + y").alias("b"), F.expr("x + 10").alias("or"), F.expr("y + 20").alias("og"), F.expr("x + y + 5").alias("ob"))
    out = G.colour_residual(p, ["clip", "instance"])
    return out.select("clip", "instance", *[r6(F.col(c)).alias(c) for c in ("error", "luma_ratio", "gain")])


@query(f"""WITH {STATES}, r AS (SELECT clip, list_sort(list(x / 100)) AS r, list_sort(list(100 / x)) AS f FROM states WHERE x > 0 GROUP BY clip) SELECT clip, round(CASE WHEN r[len(r) // 2 + 1] < 0.99 THEN least(f[len(f) // 2 + 1], 1.5) ELSE 1 END, 6) AS light FROM r""")
def g9_light_factor(spark, d):
    r = states(spark, d).where("x > 0").select("clip", (F.col("x") / 100).alias("ratio"))
    return G.light_factor(r, "clip", "ratio").withColumn("light", r6(F.col("light")))


@query(f"""WITH {STATES}, p AS (SELECT clip, floor(x)::INT % 12 AS u, floor(y)::INT % 9 AS v, event_id FROM states), a AS (SELECT DISTINCT clip, u, v FROM p WHERE event_id % 3 <> 0), b AS (SELECT DISTINCT clip, u, v FROM p WHERE event_id % 3 <> 1),
j AS (SELECT clip, u, v, (a.clip IS NOT NULL)::INT AS ia, (b.clip IS NOT NULL)::INT AS ib FROM a FULL JOIN b USING (clip, u, v))
SELECT clip, round(sum(ia * ib) / count(*), 6) AS iou, round(sqrt((avg(CASE WHEN ia = 1 THEN u END) - avg(CASE WHEN ib = 1 THEN u END)) ** 2 + (avg(CASE WHEN ia = 1 THEN v END) - avg(CASE WHEN ib = 1 THEN v END)) ** 2) / 15, 6) AS shift FROM (SELECT j.clip, u, v, EXISTS (SELECT 1 FROM a WHERE a.clip = j.clip AND a.u = j.u AND a.v = j.v)::INT AS ia, EXISTS (SELECT 1 FROM b WHERE b.clip = j.clip AND b.u = j.u AND b.v = j.v)::INT AS ib FROM j) GROUP BY clip""")
def g10_mask_agreement(spark, d):
    p = states(spark, d).select("clip", F.expr("cast(floor(x) AS int) % 12").alias("u"), F.expr("cast(floor(y) AS int) % 9").alias("v"), "event_id")
    out = G.mask_agreement(p.where("event_id % 3 <> 0"), p.where("event_id % 3 <> 1"), ["clip"], 15.0)
    return out.withColumn("iou", r6(F.col("iou"))).withColumn("shift", r6(F.col("shift")))


@query(f"""WITH {STATES}, c AS (SELECT clip, floor(t / 86400)::BIGINT AS frame, count(DISTINCT row(floor(x)::INT % 12, floor(y)::INT % 9)) / 108::DOUBLE AS c FROM states GROUP BY ALL)
SELECT clip, round(avg(c), 6) AS mean_coverage, round(max(c), 6) AS best_coverage, (SELECT frame FROM c d WHERE d.clip = c.clip ORDER BY d.c DESC, frame LIMIT 1) AS best_frame FROM c GROUP BY clip""")
def g11_pixel_coverage(spark, d):
    p = states(spark, d).select("clip", F.floor(F.col("t") / 86400).cast("long").alias("frame"), F.expr("cast(floor(x) AS int) % 12").alias("u"), F.expr("cast(floor(y) AS int) % 9").alias("v"))
    out = G.pixel_coverage(p, "clip", "frame", 108.0)
    return out.withColumn("mean_coverage", r6(F.col("mean_coverage"))).withColumn("best_coverage", r6(F.col("best_coverage")))


@query("""WITH m AS (SELECT l_partkey, list_reverse_sort([quantile_cont(l_quantity, 0.5), quantile_cont(100 * l_discount, 0.5), quantile_cont(100 * l_tax, 0.5)]) AS e FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, round(e[2] / e[1], 6) AS b, round(e[3] / e[1], 6) AS c FROM m WHERE e[1] > 0""")
def r5_observed_ratios(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("ex"), (100 * F.col("l_discount")).alias("ey"), (100 * F.col("l_tax")).alias("ez"))
    return R.observed_ratios(li, ["l_partkey"]).select("l_partkey", r6(F.col("ratios")[1]).alias("b"), r6(F.col("ratios")[2]).alias("c"))


@query(f"""WITH {TEXT_RANKED}, {SHAPES}, c AS (SELECT query, length(query) % 9 AS clip, asset_id FROM ranked WHERE rank = 1 AND score >= 0.45), t AS (SELECT p_partkey % 9 AS clip, p_partkey AS true_id, p_brand AS true_kit FROM part WHERE p_size = 7),
j AS (SELECT c.clip, c.asset_id, bool_or(c.asset_id = true_id) AS exact, bool_or(a.kit = true_kit) AS kit, min((abs(s.s[1] - ts.s[1]) + abs(s.s[2] - ts.s[2]) + abs(s.s[3] - ts.s[3])) / 3) AS far FROM c JOIN t ON c.clip = t.clip JOIN assets a ON a.asset_id = c.asset_id JOIN shapes s ON s.asset_id = c.asset_id JOIN shapes ts ON ts.asset_id = true_id GROUP BY c.clip, c.asset_id)
SELECT count(*) AS n, round(avg(exact::INT), 6) AS exact, round(avg(kit::INT), 6) AS same_kit, round(avg(far), 6) AS shape_distance FROM j""")
def r10_choice_audit(spark, d):
    part = table(spark, d, "part")
    ratios = F.array(F.lit(1.0), F.expr("(p_size % 10 + 1) / 11D"), F.expr("(p_size % 7 + 1) / 77D"))
    shapes = part.select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("kit"), ratios.alias("ratios"))
    chosen = _ranked(spark, d, 1).where("score >= 0.45").select((F.length("query") % 9).cast("long").alias("clip"), "asset_id").join(shapes, "asset_id")
    truths = part.where("p_size = 7").select((F.col("p_partkey") % 9).alias("clip"), F.col("p_partkey").alias("true_id"), F.col("p_brand").alias("true_kit"), ratios.alias("true_ratios"))
    out = R.choice_audit(chosen, truths, ["clip"])
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("exact", "same_kit", "shape_distance")])

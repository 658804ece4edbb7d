"""Likeness against its yardsticks, arms of naming, first boxes against nodes, and a dataset written as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.functions.columns import r6
from sceneloom.operators import likeness, rules
from sceneloom.operators import retrieval as R
from sceneloom.plans.adapters import NODES, nodes, table
from sceneloom.plans.registry import query
from sceneloom.plans.retrieval_queries import TEXT_RANKED, _assets, _queries, _ranked
from sceneloom.shared import shared_path
from sceneloom.sources import datasets, scenes

DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: p[1] * p[2]))"
UNIT = f"list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt({DOT.format('embedding::DOUBLE[]', 'embedding::DOUBLE[]')}), 1e-12::DOUBLE))"


@query(f"""WITH u AS (SELECT label AS clip, vec_id, {UNIT} AS v FROM embeddings), f AS (SELECT *, list_reverse(v) AS r, lead(v) OVER (PARTITION BY clip ORDER BY vec_id) AS nx FROM u),
own AS (SELECT clip, count(*) AS n, quantile_cont({DOT.format('v', 'r')}, 0.5) AS median, quantile_cont({DOT.format('v', 'nx')}, 0.5) AS self FROM f GROUP BY clip),
un AS (SELECT a.clip, quantile_cont({DOT.format('a.v', 'b.v')}, 0.5) AS unrelated FROM u a JOIN u b ON b.clip = a.clip + 1 GROUP BY a.clip),
other AS (SELECT a.clip, quantile_cont({DOT.format('a.v', 'b.r')}, 0.5) AS render FROM u a JOIN f b ON b.clip = a.clip + 1 WHERE a.clip % 2 = 0 GROUP BY a.clip)
SELECT clip, n, round(median, 5) AS median, round(self, 5) AS reference_self, round(unrelated, 5) AS reference_unrelated, round(render, 5) AS reference_other_render,
  CASE WHEN self - coalesce(render, unrelated) > 1e-6 THEN CASE WHEN render IS NULL THEN 'unrelated_video' ELSE 'other_render' END END AS normalised_against
FROM own LEFT JOIN un USING (clip) LEFT JOIN other USING (clip)""")
def r14_likeness_floors(spark, d):
    """Labels are clips, a reversed vector is a frame's rendering; the next label is the unrelated video, and every other clip has its renderings."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("place"), F.col("embedding").alias("vec"), F.reverse("embedding").alias("render"))
    unrelated = e.select((F.col("clip") - 1).alias("clip"), "place", "vec")
    renders = e.select((F.col("clip") - 1).alias("clip"), "place", F.col("render").alias("vec")).where("clip % 2 = 0")
    out = likeness.likeness_report(e, unrelated, renders, block=128)
    return out.select("clip", "n", *[F.round(c, 5).alias(c) for c in ("median", "reference_self", "reference_unrelated", "reference_other_render")], "normalised_against")


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""WITH {TEXT_RANKED}, o AS (SELECT query, min(p_type) AS truth FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' ELSE 'toy ' || lower(p_type) END AS query, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS p_type FROM part) GROUP BY query),
h AS (SELECT query, rank, list_concat({_words('name')}, {_words('kit')}) AS words FROM ranked JOIN assets USING (asset_id) WHERE rank <= 5),
arms AS (SELECT query, any_value(list_has_any({_words('truth')}, {_words('query')})) AS phrase, coalesce(bool_or(list_has_any({_words('truth')}, words)) FILTER (WHERE rank = 1), false) AS nearest, coalesce(bool_or(list_has_any({_words('truth')}, words)), false) AS top FROM o LEFT JOIN h USING (query) GROUP BY query)
SELECT count(*) AS n, round(avg(phrase::INT), 6) AS phrase, round(avg(nearest::INT), 6) AS nearest, round(avg(top::INT), 6) AS top FROM arms""")
def r13_name_arms(spark, d):
    asked = _queries(spark, d)
    kinds = table(spark, d, "part").select(F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, 's') ELSE concat('toy ', lower(p_type)) END").alias("query"),
                                           F.expr("if(p_partkey % 2 = 0, p_type, p_name)").alias("truth")).groupBy("query").agg(F.min("truth").alias("truth"))
    objects = asked.join(kinds, "query").select("query", "truth", F.col("query").alias("phrase"))
    out = R.name_arms(objects, _ranked(spark, d, 5), _assets(spark, d), ["query"])
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("phrase", "nearest", "top")])


@query(f"""WITH {NODES}, n AS (SELECT clip, CASE WHEN node % 5 = 0 THEN node - 1 ELSE node END AS id, count(*) AS k, any_value(node) AS node FROM nodes GROUP BY ALL),
b AS (SELECT nodes.*, k FROM nodes LEFT JOIN n ON n.clip = nodes.clip AND n.id = nodes.node WHERE nodes.node % 6 <> 5),
m AS (SELECT clip, node, CASE WHEN k = 1 THEN node % 3 <> 1 END AS center, CASE WHEN k = 1 THEN node % 4 <> 2 END AS size, CASE WHEN k = 1 AND (clip + node) % 4 <> 0 THEN true END AS quat FROM b)
SELECT clip, node::VARCHAR AS object_id, center, size, quat, CASE WHEN NOT (coalesce(center, true) AND coalesce(size, true)) THEN 'changed' WHEN center IS NULL OR size IS NULL OR quat IS NULL THEN 'unavailable' ELSE 'matches_first_obb' END AS status FROM m""")
def v10_first_boxes(spark, d):
    """Nodes against boxes that were seen in them: some moved, some resized, turned the other way round, or with an id that two nodes have."""
    turn = F.lit(0.2) * (F.col("node") % 8)
    q = nodes(spark, d).withColumns({"qx": F.lit(0.0), "qy": F.sin(turn), "qz": F.lit(0.0), "qw": F.cos(turn)})
    own = q.withColumn("node_id", F.expr("cast(if(node % 5 = 0, node - 1, node) AS string)"))
    seen = q.where("node % 6 <> 5").withColumn("t", F.explode(F.array(F.lit(None).cast("double"), F.lit(1.5), F.lit(0.5)))).withColumns({
        "object_id": F.col("node").cast("string"), "px": F.expr("px + if(t = 0.5, if(node % 3 = 1, 0.002D, 0.0003D), 9D)"), "ex": F.expr("ex + if(node % 4 = 2, 0.001D, 0D)"),
        "qw": F.expr("if((clip + node) % 4 = 0, double('NaN'), if(node % 2 = 0, -qw, qw))"), "qy": F.expr("if(node % 2 = 0, -qy, qy)"),
    })
    return rules.first_box_comparison(seen, own)


@query(f"""WITH {NODES}, c AS (SELECT clip, 'c' || (clip - clip % 4) || CASE clip % 4 WHEN 1 THEN '_style' WHEN 2 THEN '_behavior' WHEN 3 THEN '_other' ELSE '' END AS name, clip % 10 = 5 AS failed, 'f' || (clip % 3) AS family, count(*) AS nodes FROM nodes GROUP BY clip),
w AS (SELECT * FROM c WHERE NOT failed)
SELECT c.name AS clip, c.family, CASE WHEN c.failed THEN 'failed' ELSE 'written' END AS status, CASE WHEN c.clip % 7 = 0 THEN 1 ELSE 0 END AS warnings, CASE WHEN NOT c.failed THEN c.nodes ELSE 0 END AS nodes,
  CASE WHEN NOT c.failed AND b.name IS NOT NULL THEN CASE c.clip % 4 WHEN 1 THEN 'style_variant' WHEN 2 THEN 'behavior_variant' END END AS kind
FROM c LEFT JOIN w b ON c.clip % 4 IN (1, 2) AND b.name = 'c' || (c.clip - c.clip % 4)""")
def s6_dataset_documents(spark, d):
    """Every order as a document of a dataset with manifest and pairs, read back by its readers."""
    n = nodes(spark, d).withColumn("id", F.col("node").cast("string"))
    name = F.expr("concat('c', clip - clip % 4, CASE clip % 4 WHEN 1 THEN '_style' WHEN 2 THEN '_behavior' WHEN 3 THEN '_other' ELSE '' END)")
    member = F.array_sort(F.collect_list(F.struct("node", F.struct("id", "class").alias("n"))))
    docs = n.groupBy("clip").agg(member.alias("o")).select("clip", name.alias("name"), F.expr("concat('f', clip % 3)").alias("family"), "o")
    programs = docs.select(F.col("name").alias("clip"), "family", F.to_json(F.struct(F.struct(F.col("name").alias("clip")).alias("meta"), F.col("o.n").alias("objects"))).alias("program"))
    found = docs.select(F.col("name").alias("clip"), F.explode(F.filter(F.array(
        F.when(F.col("clip") % 10 == 5, F.struct(F.lit("error").alias("severity"), F.lit("support_unknown").alias("code"))),
        F.when(F.col("clip") % 7 == 0, F.struct(F.lit("warning").alias("severity"), F.lit("unsupported").alias("code")))), lambda x: x.isNotNull())).alias("f")).select("clip", "f.*")
    path = shared_path(spark, "documents")
    told = datasets.write_documents(programs, found, path, "train", 20261013)
    read = scenes.read_programs(spark, f"{path}/programs", lines=True).groupBy("clip").agg(F.count(F.lit(1)).alias("nodes"))
    pairs = datasets.read_pairs(spark, path).select(F.col("variant").alias("clip"), "kind")
    out = told.select("clip", "family", "status", F.size("warnings").alias("warnings")).join(read, "clip", "left").join(pairs, "clip", "left")
    return out.na.fill(0, ["nodes"]).select("clip", "family", "status", "warnings", "nodes", "kind")

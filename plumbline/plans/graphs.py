"""Knowledge graphs: building, walking, summaries, references."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.plans.calibration import STATS_SQL, normal_reference_rows
from plumbline.plans.fixtures import KB_SQL, knowledge, knowledge_files, scores
from plumbline.plans.registry import query, table
from plumbline.session import shared_path
from plumbline.sources import documents, sinks
from plumbline.sources.documents import knowledge_bases

EDGES_SQL = (
    KB_SQL
    + """, edges AS (
  SELECT category, target AS src, region AS dst, 'has_region' AS relation, CAST(NULL AS VARCHAR) AS logic FROM kb_regions
  UNION ALL SELECT category, region, region || '_' || type, 'possible_anomaly', NULL FROM kb_defects
  UNION ALL SELECT category, region || '_' || type, region || '_' || target_defect, 'distinct_from', difference FROM kb_defects WHERE target_defect IS NOT NULL),
nodes AS (SELECT category, target AS node_id, 'root' AS type FROM kb_regions WHERE pos = 0 UNION ALL SELECT category, region, 'region' FROM kb_regions
  UNION ALL SELECT category, region || '_' || type, 'defect_pattern' FROM kb_defects UNION ALL SELECT category, region || '_phantom_mark', NULL FROM kb_defects WHERE target_defect = 'phantom_mark')"""
)


def graph(spark, folder):
    bases = knowledge(spark, folder).select("category", "kb")
    return G.graph_nodes(bases), G.graph_edges(bases)


@query(
    "grf1_graph_edges",
    "WITH " + EDGES_SQL + " SELECT category, src, dst, relation, logic FROM edges WHERE category IN (SELECT 'part_' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size BETWEEN 3 AND 45 AND p_partkey % 17 <> 0)",
)
def graph_edges(spark, folder):
    """From knowledge files: unreadable ones and skipped names give no graph."""
    bases = knowledge_bases(knowledge_files(spark, folder))
    return G.graph_edges(bases).select("category", "src", "dst", "relation", "logic")


@query("grf1_graph_nodes", "WITH " + EDGES_SQL + " SELECT * FROM nodes")
def graph_nodes(spark, folder):
    return graph(spark, folder)[0].select("category", "node_id", "type")


@query(
    "jn4_region_defects",
    "WITH "
    + KB_SQL
    + """ SELECT category, region, type AS defect, target || ' -> ' || region || ' -> ' || region || '_' || type AS graph_path, array_to_string(attributes, ',') AS attributes,
      CASE WHEN k = 0 THEN target_defect || ': ' || difference WHEN target_defect IS NOT NULL THEN region || '_phantom_mark: N/A' ELSE '' END AS distinctions FROM kb_defects""",
)
def region_defects(spark, folder):
    out = G.region_defects(*graph(spark, folder))
    listed = F.transform("distinctions", lambda d: F.concat_ws(": ", d["target_defect"], d["difference"]))
    return out.select(
        "category", "region", "defect", "graph_path", F.array_join("visual_attributes", ",").alias("attributes"), F.array_join(listed, "; ").alias("distinctions")
    )


@query(
    "agg15_graph_summary",
    "WITH "
    + EDGES_SQL
    + """, n AS (SELECT category, count(*) AS node_count, count(*) FILTER (type = 'region') AS region_count, count(*) FILTER (type = 'defect_pattern') AS defect_count FROM nodes GROUP BY category),
    e AS (SELECT category, count(*) AS edge_count FROM edges GROUP BY category), r AS (SELECT category, string_agg(region, ', ' ORDER BY pos) AS names FROM kb_regions GROUP BY category)
    SELECT * FROM n JOIN e USING (category) JOIN r USING (category)""",
)
def graph_summary(spark, folder):
    return G.graph_summary(*graph(spark, folder))


REGION_TEXT_SQL = """texts AS (SELECT r.category, r.region, r.pos, r.p_partkey,
  '--- Reference Knowledge for Region: ''' || r.region || ''' ---' || chr(10) || 'Definition: ' || definition
  || CASE WHEN normal_standard <> 'N/A' THEN chr(10) || 'Normal Standard: ' || normal_standard ELSE '' END
  || CASE WHEN critical_check NOT IN ('', 'N/A') THEN chr(10) || 'Critical Check: ' || critical_check ELSE '' END
  || chr(10) || chr(10) || '[Potential Defects Details]:' || chr(10) || d.details || chr(10) || chr(10) || '[Anti-Hallucination Rules]:' || chr(10) || '!!! Do not guess' AS text
  FROM kb_regions r JOIN (SELECT category, region, string_agg(chr(10) || '>>> Defect: ' || type || chr(10) || '    Visual Signature: ' || signature || chr(10) || '    Contrast vs Normal: ' || contrast
    || CASE WHEN difference <> 'N/A' THEN chr(10) || '    * Distinction vs ' || target_defect || ': ' || difference ELSE '' END, chr(10) ORDER BY k) AS details FROM kb_defects GROUP BY ALL) d USING (category, region))"""


@query("txt12_region_text", "WITH " + KB_SQL + ", " + REGION_TEXT_SQL + " SELECT category, region, text FROM texts")
def region_text(spark, folder):
    nodes, edges = graph(spark, folder)
    return G.region_text(nodes, G.region_defects(nodes, edges))


SPEC_RULES = [
    ("parts", 0, "^small", ["whole_object", "mounting_holes"]),
    ("parts", 1, "bolt$", ["whole_object", "thread", "head"]),
    ("parts", 2, ".*", ["whole_object", "part_surface", "outer_contour"]),
    ("textures", 0, ".*", ["whole_object", "texture_field", "central_patch"]),
]
SPEC_SQL = """cats AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'parts' ELSE 'textures' END AS dataset, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_type END AS category FROM part),
 specs AS (SELECT dataset, category, unnest(CASE WHEN dataset = 'textures' THEN ['whole_object', 'texture_field', 'central_patch'] WHEN category LIKE 'small%' THEN ['whole_object', 'mounting_holes']
   WHEN category LIKE '%bolt' THEN ['whole_object', 'thread', 'head'] ELSE ['whole_object', 'part_surface', 'outer_contour'] END) AS region FROM cats)"""


def _specs(spark, folder):
    # the rules are documents in files, as a user would keep them
    path = shared_path(spark, "region-specs")
    docs = [(d, json.dumps({"dataset": d, "rule_order": k, "pattern": p, "regions": [{"region": n} for n in names]})) for d, k, p, names in SPEC_RULES]
    sinks.write_documents(spark.createDataFrame(docs, "folder string, text string"), path, ["folder"])
    rules = documents.region_spec_rules(documents.read_json_files(spark, path))
    part = table(spark, folder, "part")
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    cats = part.select(F.when(F.col("p_size") % 2 == 0, "parts").otherwise("textures").alias("dataset"), name.alias("category")).distinct()
    return G.matching_specs(cats, rules)


@query("grf3_region_specs", "WITH " + SPEC_SQL + " SELECT dataset, category, region FROM specs")
def region_specs(spark, folder):
    return _specs(spark, folder).select("dataset", "category", "region")


@query(
    "grf2_spec_graph",
    "WITH " + SPEC_SQL + " SELECT dataset, category, category AS src, region AS dst, 'has_region' AS relation FROM specs UNION ALL SELECT dataset, category, region, region || '_visible_anomaly', 'possible_anomaly' FROM specs",
)
def spec_graph(spark, folder):
    return G.spec_graph(_specs(spark, folder))


REF_SQL = (
    STATS_SQL
    + """, picked AS (SELECT dataset, category, image_path, score, place, CASE place WHEN 1 THEN 'rim edge' WHEN 2 THEN 'core' END AS region FROM (
      SELECT t.dataset, t.category, t.image_path, t.score, row_number() OVER (PARTITION BY dataset, category ORDER BY abs(t.score - b.med), t.score, t.image_path) AS place FROM train t JOIN base b USING (dataset, category)) WHERE place <= 3),
    known AS (SELECT DISTINCT dataset, category, 'rim edge' AS region FROM picked),
    refs AS (SELECT *, 'normal_ref_' || CAST(place AS VARCHAR) || coalesce('_' || replace(region, ' ', '_'), '') AS node_id FROM picked)
"""
)


def _reference_graph(spark, folder):
    picked = normal_reference_rows(scores(spark, folder).where("split = 'train'"), 3)
    picked = picked.withColumn("region", F.when(F.col("place") == 1, "rim edge").when(F.col("place") == 2, "core"))
    regions = picked.where("place = 1").select("dataset", "category", F.lit("rim edge").alias("region"))
    return G.normal_reference_graph(picked, regions)


@query(
    "grf4_reference_nodes",
    REF_SQL
    + """SELECT DISTINCT dataset, category, 'category' AS node_id, 'object_category' AS node_type, '' AS image_path, CAST(NULL AS DOUBLE) AS score FROM refs
    UNION ALL SELECT DISTINCT dataset, category, 'normal_distribution', 'score_distribution', '', NULL FROM refs
    UNION ALL SELECT dataset, category, 'region:rim_edge', 'region', '', NULL FROM known
    UNION ALL SELECT dataset, category, node_id, 'visual_reference_cutout', image_path, score FROM refs""",
)
def reference_nodes(spark, folder):
    return _reference_graph(spark, folder)[0]


@query(
    "grf4_reference_edges",
    REF_SQL
    + """SELECT DISTINCT dataset, category, 'category' AS source, 'normal_distribution' AS target, 'has_normal_score_model' AS relation FROM refs
    UNION ALL SELECT dataset, category, 'category', 'region:rim_edge', 'has_region' FROM known
    UNION ALL SELECT dataset, category, 'region:rim_edge', node_id, 'has_normal_reference' FROM refs WHERE region = 'rim edge'
    UNION ALL SELECT dataset, category, 'normal_distribution', node_id, 'supported_by' FROM refs""",
)
def reference_edges(spark, folder):
    return _reference_graph(spark, folder)[1]


OFFLINE_SQL = """items AS (SELECT r_name AS category, n_name AS region, n_nationkey AS region_order, s_suppkey AS ordinal, 'ref/' || s_name || '.png' AS path
   FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
 first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, region ORDER BY ordinal) AS place FROM items) WHERE place <= 2)"""


def _items(spark, folder):
    places = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, folder, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    items = rows.select(
        F.col("r_name").alias("category"),
        F.col("n_name").alias("region"),
        F.col("n_nationkey").alias("region_order"),
        F.col("s_suppkey").alias("ordinal"),
        F.concat(F.lit("ref/"), "s_name", F.lit(".png")).alias("path"),
    )
    return G.first_per_region(items, 2, ["category"])


@query("win2_offline_references", "WITH " + OFFLINE_SQL + " SELECT category, region, region_order, CAST(place AS INTEGER) AS place, path FROM first")
def offline_references(spark, folder):
    return _items(spark, folder).select("category", "region", "region_order", "place", "path").orderBy("category", "region_order", "place")


@query("grf5_paths_by_region", "WITH " + OFFLINE_SQL + " SELECT category, region, string_agg(path, ',' ORDER BY place) AS paths FROM first GROUP BY ALL")
def paths_by_region(spark, folder):
    out = G.paths_by_region(_items(spark, folder), ["category"])
    return out.select("category", "region", F.array_join("paths", ",").alias("paths"))


@query(
    "grf6_resolved_references",
    """WITH r AS (SELECT 'part_' || CAST(l_partkey AS VARCHAR) AS category, l_returnflag AS region, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS at,
       CASE WHEN l_linenumber % 2 = 0 THEN '/old/databases/img/' ELSE '/new/img/' END || CAST(l_suppkey % 40 AS VARCHAR) || '.png' AS path FROM lineitem),
    m AS (SELECT DISTINCT '/new/img/' || CAST(s_suppkey % 40 AS VARCHAR) || '.png' AS path FROM supplier WHERE s_acctbal > 5000),
    t AS (SELECT category, region, at, unnest([0, 1]) AS try_, unnest([path, CASE WHEN contains(path, '/databases/img/') THEN '/new/img/' || string_split(path, '/databases/img/')[2] END]) AS path FROM r),
    b AS (SELECT category, region, at, arg_min(path, try_) AS path FROM t JOIN m USING (path) GROUP BY ALL)
    SELECT category, region, path, min(at) AS first_at FROM b GROUP BY ALL""".replace(" AS at,", " AS slot,").replace("region, at,", "region, slot,").replace("min(at)", "min(slot)"),
)
def resolved_references(spark, folder):
    item = table(spark, folder, "lineitem")
    at = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    head = F.when(F.col("l_linenumber") % 2 == 0, "/old/databases/img/").otherwise("/new/img/")
    paths = item.select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("category"),
        F.col("l_returnflag").alias("region"),
        at.alias("at"),
        F.concat(head, (F.col("l_suppkey") % 40).cast("string"), F.lit(".png")).alias("path"),
    )
    manifest = table(spark, folder, "supplier").where("s_acctbal > 5000").select(
        F.concat(F.lit("/new/img/"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".png")).alias("path")
    )
    out = G.resolve_references(paths, manifest, marker="/databases/img/", root="/new/img/")
    return out.withColumnRenamed("at", "first_at")

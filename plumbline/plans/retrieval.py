"""Retrieval plans, provenance, prompt choices and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evidence as E
from plumbline.operators import graph as G
from plumbline.operators import retrieval as R
from plumbline.operators import trace as TR
from plumbline.operators import words
from plumbline.operators.joins import attach, meet
from plumbline.plans import textsql as S
from plumbline.plans.evidence import (
    HYPO_SQL,
    NORMAL_SQL,
    OPTIONS,
    REPORTS,
    _pick,
    _sql_pick,
    defects,
    order_reports,
)
from plumbline.plans.fixtures import BOXES_SQL, KB_SQL, SCORES_SQL, boxes, knowledge, scores
from plumbline.plans.graphs import REGION_TEXT_SQL, graph
from plumbline.plans.registry import query, table
from plumbline.session import shared_path
from plumbline.sources import documents, sinks

REQUEST_SQL = (
    KB_SQL
    + """, requests AS (SELECT o_orderkey AS request_id, o_custkey AS p_partkey, CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'semantic_topk' WHEN 2 THEN 'hybrid' ELSE 'Semantic_TopK' END AS mode,
      CAST(o_orderkey % 3 AS INTEGER) AS top_k, o_custkey % 5 <> 0 AS has_query, o_orderkey % 7 <> 0 AS include_global FROM orders),
    emb AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM embeddings),
    rr AS (SELECT q.*, r.region, r.pos, r.category, row_number() OVER (PARTITION BY q.request_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, r.pos) AS rk, r.critical_check
      FROM requests q JOIN kb_regions r USING (p_partkey) JOIN emb a ON a.vec_id = q.request_id % 150 JOIN emb b ON b.vec_id = (q.p_partkey * 5 + r.pos) % 150),
    f AS (SELECT *, has_query AND top_k > 0 AS asked, lower(mode) AS m, CASE WHEN has_query AND rk <= top_k THEN rk END AS rank, include_global AND (contains(lower(region), 'whole') OR contains(lower(region), 'global')) AS glb,
      critical_check NOT IN ('', 'N/A') AS crit FROM rr),
    g AS (SELECT *, NOT (asked AND m IN ('semantic_topk', 'hybrid')) AS full_ FROM f),
    t AS (SELECT *, CASE WHEN full_ OR glb THEN 0 WHEN m = 'hybrid' AND crit THEN 1 WHEN rank IS NOT NULL AND asked THEN 2 END AS tier FROM g),
    u AS (SELECT *, count(tier) OVER (PARTITION BY request_id) AS chosen FROM t),
    v AS (SELECT *, chosen = 0 AND pos < CASE WHEN top_k > 0 THEN top_k ELSE 99 END AS fb FROM u),
    plan AS (SELECT *, tier IS NOT NULL OR fb AS selected, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(tier, CASE WHEN fb THEN 3 ELSE 9 END), CASE WHEN tier = 2 THEN rank ELSE pos END, pos) AS ord,
      list_filter([CASE WHEN glb THEN 'global_or_whole_standard' END, CASE WHEN crit THEN 'critical_check_available' END, CASE WHEN rank IS NOT NULL AND asked THEN 'semantic_rank_' || CAST(rank AS VARCHAR) END,
        CASE WHEN full_ THEN 'full_graph_context' END, CASE WHEN fb THEN 'fallback_region_order' END], lambda x: x IS NOT NULL) AS reasons FROM v)"""
)


def _plan(spark, folder):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    requests = table(spark, folder, "orders").select(
        order.alias("request_id"),
        F.concat(F.lit("part_"), cust.cast("string")).alias("category"),
        _pick(["full", "semantic_topk", "hybrid", "Semantic_TopK"], order % 4).alias("mode"),
        (order % 3).cast("int").alias("top_k"),
        (cust % 5 != 0).alias("has_query"),
        (order % 7 != 0).alias("include_global"),
    )
    regions = G.region_rows(knowledge(spark, folder)).select("category", "region", "pos", "critical_check")
    number = F.regexp_extract("category", r"(\d+)$", 1).cast("long")
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    asked = meet(requests.withColumn("vec_id", F.col("request_id") % 150), vectors.withColumnRenamed("vec", "asked"), ["vec_id"]).drop("vec_id")
    known = meet(regions.withColumn("vec_id", (number * 5 + F.col("pos")) % 150), vectors.withColumnRenamed("vec", "known"), ["vec_id"]).drop("vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("asked", "known") / F.sqrt(dot("asked", "asked") * dot("known", "known"))
    return R.plan_regions(asked, known, cosine)


@query(
    "rag1_retrieval_plan",
    "WITH " + REQUEST_SQL + " SELECT request_id, region, selected, CASE WHEN selected THEN CAST(ord AS INTEGER) END AS selected_order, array_to_string(reasons, ',') AS reasons FROM plan",
)
def retrieval_plan(spark, folder):
    return _plan(spark, folder).select("request_id", "region", "selected", "selected_order", F.array_join("reasons", ",").alias("reasons"))


@query(
    "agg14_reason_counts",
    "WITH "
    + REQUEST_SQL
    + """, e AS (SELECT request_id, unnest(reasons) AS reason FROM plan WHERE selected), c AS (SELECT request_id, reason, count(*) AS n FROM e GROUP BY ALL)
    SELECT request_id, string_agg(reason || '=' || CAST(n AS VARCHAR), ',' ORDER BY reason || '=' || CAST(n AS VARCHAR)) AS reason_counts FROM c GROUP BY request_id""",
)
def reason_counts(spark, folder):
    return R.reason_counts(_plan(spark, folder))


@query(
    "rag2_context_blocks",
    "WITH "
    + REQUEST_SQL
    + ", "
    + REGION_TEXT_SQL
    + """ SELECT request_id, p.region, CAST(ord AS INTEGER) AS block_order, text, true AS prompt_visible, lower(mode) AS mode, array_to_string(reasons, ',') AS reasons
      FROM plan p JOIN texts USING (p_partkey, region) WHERE selected
    UNION ALL SELECT request_id, 'option_grounding', 0, '', false, lower(mode), '' FROM requests WHERE request_id % 5 = 0""",
)
def context_blocks(spark, folder):
    """A block per selected region with its text, plus an audit-only option block where grounding was asked for."""
    plan = _plan(spark, folder)
    nodes, edges = graph(spark, folder)
    texts = G.region_text(nodes, G.region_defects(nodes, edges))
    blocks = meet(plan.where("selected"), texts, ["category", "region"]).select(
        "request_id",
        "region",
        F.col("selected_order").alias("block_order"),
        "text",
        F.lit(True).alias("prompt_visible"),
        F.lower("mode").alias("mode"),
        F.array_join("reasons", ",").alias("reasons"),
    )
    question = F.when(F.col("request_id") % 5 == 0, "Which type of the defect is shown?").otherwise("Is it normal?")
    asked = plan.select("request_id", "mode").distinct().where(T.wants_grounding(question))
    audit = asked.select(
        "request_id",
        F.lit("option_grounding").alias("region"),
        F.lit(0).alias("block_order"),
        F.lit("").alias("text"),
        F.lit(False).alias("prompt_visible"),
        F.lower("mode").alias("mode"),
        F.lit("").alias("reasons"),
    )
    return blocks.unionByName(audit)


REFERENCE_SQL = """refs AS (SELECT l_orderkey AS block_id, CASE WHEN l_orderkey % 4 = 0 THEN 'unknown' ELSE 'normal_reference_region_cutouts' END AS source,
  CASE l_orderkey % 3 WHEN 0 THEN 'normal samples by SAM3 segmentation' WHEN 1 THEN 'hand drawn reference' ELSE 'Reference images, direct copy' END AS generation,
  CASE WHEN l_linenumber = 7 THEN '' ELSE 'img/' || CAST(l_suppkey AS VARCHAR) || '.png' END AS path FROM lineitem),
 manifest AS (SELECT 'img/' || CAST(s_suppkey AS VARCHAR) || '.png' AS path FROM supplier WHERE s_acctbal > 1000)"""


@query(
    "rag3_trust_audit",
    "WITH "
    + REFERENCE_SQL
    + """, c AS (SELECT block_id, any_value(source) = 'normal_reference_region_cutouts' AND any_value(generation) <> 'hand drawn reference' AS trusted_source, count(*) FILTER (path <> '') AS path_count,
       count(*) FILTER (path IN (SELECT path FROM manifest)) AS existing_path_count FROM refs GROUP BY block_id)
    SELECT *, path_count - existing_path_count AS missing_path_count, trusted_source AND path_count > 0 AND existing_path_count = path_count AS source_backed FROM c""",
)
def trust_audit(spark, folder):
    order = F.col("l_orderkey")
    refs = table(spark, folder, "lineitem").select(
        order.alias("block_id"),
        F.when(order % 4 == 0, "unknown").otherwise(R.REFERENCE_SOURCE).alias("source"),
        _pick(["normal samples by SAM3 segmentation", "hand drawn reference", "Reference images, direct copy"], order % 3).alias("generation"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("img/"), F.col("l_suppkey").cast("string"), F.lit(".png"))).alias("path"),
    )
    manifest = table(spark, folder, "supplier").where("s_acctbal > 1000").select(
        F.concat(F.lit("img/"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("path")
    )
    return R.trust_audit(refs, manifest, ["block_id"])


@query(
    "rag4_metadata_checks",
    """SELECT p_partkey, true AS present, p_size % 2 = 0 AS dataset_matches, p_size % 3 <> 0 AS category_matches, p_size % 4 <> 0 AS knowledge_source_type_trusted, p_size % 5 <> 0 AS source_json_matches,
      p_size % 6 <> 0 AS visual_reference_root_matches, p_size % 7 <> 0 AS visual_reference_source_trusted, p_size % 7 <> 0 AND p_size % 8 <> 0 AS visual_reference_generation_trusted,
      p_size % 9 <> 0 AS builder_recorded, p_size % 10 <> 0 AS graph_output_root_matches FROM part""",
)
def metadata_checks(spark, folder):
    size = F.col("p_size")

    def when(n, good, bad):
        return F.when(size % n != 0, good).otherwise(bad)

    metadata = {
        "dataset": F.when(size % 2 == 0, "SetA").otherwise("setb"),
        "category": when(3, F.col("p_name"), F.lit("other")),
        "knowledge_source_type": F.lit("unknown"),
        "source_type": when(4, R.KNOWLEDGE_SOURCE, None),
        "source_json_path": when(5, "/kb/./a//part.json", "/kb/b/part.json"),
        "visual_reference_root": when(6, "/img/", ""),
        "visual_reference_source": when(7, R.REFERENCE_SOURCE, "x"),
        "visual_reference_generation": when(8, "normal crops by segmentation", "unknown"),
        "visual_reference_builder": when(9, "builder", "  "),
        "graph_output_root": when(10, "/graphs", "/graph"),
    }
    expected = {
        "dataset": F.lit("seta"),
        "category": F.col("p_name"),
        "source_json_path": F.lit("/kb/a/part.json"),
        "visual_reference_root": F.lit("/img"),
        "graph_output_root": F.lit("/graphs"),
    }
    checks = R.metadata_checks(metadata, expected)
    return table(spark, folder, "part").select("p_partkey", *[c.alias(n) for n, c in checks.items()])


@query(
    "rag6_knowledge_paths",
    """WITH q AS (SELECT p_partkey AS request_id, p_name AS subclass, CASE WHEN p_size % 4 = 0 THEN 'text_knowledge/visa/' || p_name || '.json' WHEN p_size % 4 = 1 THEN 'nowhere.json' END AS recorded, CASE WHEN p_size % 2 = 0 THEN 'graph_index_small' ELSE 'graphs' END AS gr FROM part),
    m AS (SELECT DISTINCT unnest(['text_knowledge/visa/' || p_name || '.json', 'text_knowledge_weak_agent/mvtec/' || p_name || '.json', 'text_knowledge_small/mvtec/' || p_name || '.json']) AS path FROM part WHERE p_name NOT LIKE '%anvil'),
    c AS (SELECT request_id, unnest(range(7)) AS slot, unnest([recorded, CASE WHEN gr LIKE 'graph_index%' THEN 'text_knowledge' || substr(gr, 12) || '/mvtec/' || subclass || '.json' END, CASE WHEN gr LIKE 'graph_index%' THEN 'text_knowledge' || substr(gr, 12) || '/visa/' || subclass || '.json' END,
      'text_knowledge/mvtec/' || subclass || '.json', 'text_knowledge/visa/' || subclass || '.json', 'text_knowledge_weak_agent/mvtec/' || subclass || '.json', 'text_knowledge_weak_agent/visa/' || subclass || '.json']) AS path FROM q),
    f AS (SELECT request_id, path, min(slot) AS slot FROM c JOIN m USING (path) GROUP BY ALL), o AS (SELECT *, min(slot) OVER (PARTITION BY request_id) AS lo FROM f)
    SELECT request_id, string_agg(path, ',' ORDER BY slot) AS paths FROM o WHERE lo > 0 OR slot = 0 GROUP BY request_id""",
)
def knowledge_paths(spark, folder):
    part = table(spark, folder, "part")
    size, name = F.col("p_size"), F.col("p_name")
    requests = part.select(
        F.col("p_partkey").alias("request_id"),
        name.alias("subclass"),
        F.when(size % 4 == 0, F.concat(F.lit("text_knowledge/visa/"), name, F.lit(".json"))).when(size % 4 == 1, "nowhere.json").alias("recorded_path"),
        F.when(size % 2 == 0, "graph_index_small").otherwise("graphs").alias("graph_root"),
    )
    places = ["text_knowledge/visa/", "text_knowledge_weak_agent/mvtec/", "text_knowledge_small/mvtec/"]
    manifest = part.where(~name.endswith("anvil")).select(
        F.explode(F.array(*[F.concat(F.lit(p), name, F.lit(".json")) for p in places])).alias("path")
    )
    out = R.knowledge_path(requests, manifest, ["text_knowledge", "text_knowledge_weak_agent"])
    return out.select("request_id", F.array_join("paths", ",").alias("paths"))


def _hypotheses(spark, folder):
    return E.rank_reports(order_reports(spark, folder), defects(spark, folder))


@query(
    "jn8_supported_hypotheses",
    "WITH "
    + HYPO_SQL
    + """ SELECT h.o_orderkey AS report_id, node AS defect_node FROM hypo h JOIN asked a USING (o_orderkey) WHERE (a.p_partkey + h.ord // 2) % 4 <> 0 AND h.ord % 2 = 0""",
)
def supported_hypotheses(spark, folder):
    found = _hypotheses(spark, folder)
    known = defects(spark, folder)
    number = F.regexp_extract("category", r"(\d+)$", 1).cast("long")
    backing = known.select("category", "region", F.floor(F.col("defect_order") / 2).alias("pos")).distinct()
    backing = backing.select(
        "category",
        "region",
        F.lit("graphs/a.bin").alias("graph_cache_path"),
        F.when((number + F.col("pos")) % 4 != 0, "kb/a.json").alias("source_json_path"),
        F.lit(0).alias("text_path_count"),
    )
    supported = known.where(F.col("defect_order") % 2 == 0).select("category", F.col("defect_node").alias("graph_path"))
    rows = found.withColumn("graph_path", F.col("defect_node"))
    return R.supported_hypotheses(rows, backing, supported, ["category"]).select("report_id", "defect_node")


@query(
    "jn9_prompt_blocks",
    "WITH "
    + HYPO_SQL
    + """, b AS (SELECT o_orderkey, region, pos FROM asked JOIN kb_regions USING (p_partkey) WHERE NOT (o_orderkey % 3 = 0 AND pos = 0) AND NOT (o_orderkey % 6 = 0 AND pos = 1)),
    l AS (SELECT DISTINCT o_orderkey, region FROM hypo WHERE NOT contains(lower(region), 'whole')),
    j AS (SELECT b.*, l.region IS NOT NULL OR contains(lower(b.region), 'whole') AS keep, EXISTS (SELECT 1 FROM l x WHERE x.o_orderkey = b.o_orderkey) AS has_local FROM b LEFT JOIN l USING (o_orderkey, region)),
    k AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY o_orderkey) AS kept FROM j)
    SELECT o_orderkey AS report_id, region, CASE WHEN NOT has_local THEN 'full_fallback_no_local_hypothesis' WHEN kept = 0 THEN 'full_fallback_unmatched_hypothesis' ELSE 'hypothesis_region_filter' END AS mode
    FROM k WHERE NOT has_local OR kept = 0 OR keep""",
)
def prompt_blocks(spark, folder):
    regions = G.region_rows(knowledge(spark, folder)).select("category", "region", F.col("pos").alias("ordinal"))
    rows = meet(order_reports(spark, folder).select("report_id", "category"), regions, ["category"])
    hidden = ((F.col("report_id") % 3 == 0) & (F.col("ordinal") == 0)) | ((F.col("report_id") % 6 == 0) & (F.col("ordinal") == 1))
    blocks = rows.select("report_id", "region", (~hidden).alias("prompt_visible"))
    out = R.select_blocks(blocks, _hypotheses(spark, folder).select("report_id", "region"), "report_id")
    return out.select("report_id", "region", "mode")


ROLES = ["whole_object", "rim", "defect_crack", "defect_hole", "target_object", "core", "defect_stain", "thread", "defect_cut"]
PLAN_TASKS = ["Defect Localization", "Defect Description", "Anomaly Detection", "Object Details"]


#: From rows ``p`` (p_partkey, task, ord, role, audited, off) to ranked ones ``o``.
PLAN_SQL = """f AS (SELECT *, CASE WHEN role IN ('whole_object', 'target_object') THEN 'object' WHEN role LIKE 'defect_%' THEN 'defect' ELSE 'part' END AS family, task = 'Defect Localization' AS loc, task = 'Defect Description' AS str FROM p),
    r AS (SELECT *, CASE WHEN task = 'Defect Localization' THEN CASE family WHEN 'defect' THEN 3 WHEN 'part' THEN 2 ELSE 1 END WHEN task = 'Defect Description' THEN CASE family WHEN 'defect' THEN 3 ELSE 2 END
       WHEN task = 'Anomaly Detection' THEN CASE family WHEN 'defect' THEN 3 WHEN 'object' THEN 2 ELSE 1 END ELSE CASE family WHEN 'object' THEN 1 WHEN 'part' THEN 0.75 ELSE 0.5 END END::DOUBLE AS relevance,
       CASE WHEN NOT audited THEN 'not_in_audited_auto_roles' WHEN family = 'defect' AND NOT (loc OR (str AND NOT off)) THEN 'defect_prompt_requires_localization_task'
         WHEN family <> 'object' AND NOT (loc OR str) THEN 'part_prompt_requires_localization_description_or_analysis' END AS no FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY no IS NOT NULL, relevance DESC, ord, role) AS place, CASE WHEN family = 'defect' AND loc THEN 'selected_defect_prompt_for_localization' WHEN family = 'defect' THEN 'selected_defect_prompt_for_defect_qa' WHEN family = 'object' THEN 'selected_object_prompt'
         WHEN str THEN 'selected_audited_part_for_structural_task' ELSE 'selected_audited_part_for_localization' END AS yes FROM r)"""


@query(
    "win11_prompt_plan",
    f"""WITH p AS (SELECT p_partkey, {_sql_pick(PLAN_TASKS, 'p_partkey % 4')} AS task, CAST(i AS INTEGER) AS ord, {_sql_pick(ROLES, 'i')} AS role, (p_size + i) % 5 <> 0 AS audited, p_size % 6 = 0 AS off FROM part, (SELECT unnest(range(9)) AS i)),
    f AS (SELECT *, CASE WHEN role IN ('whole_object', 'target_object') THEN 'object' WHEN role LIKE 'defect_%' THEN 'defect' ELSE 'part' END AS family, task = 'Defect Localization' AS loc, task = 'Defect Description' AS str FROM p),
    r AS (SELECT *, CASE WHEN task = 'Defect Localization' THEN CASE family WHEN 'defect' THEN 3 WHEN 'part' THEN 2 ELSE 1 END WHEN task = 'Defect Description' THEN CASE family WHEN 'defect' THEN 3 ELSE 2 END
       WHEN task = 'Anomaly Detection' THEN CASE family WHEN 'defect' THEN 3 WHEN 'object' THEN 2 ELSE 1 END ELSE CASE family WHEN 'object' THEN 1 WHEN 'part' THEN 0.75 ELSE 0.5 END END::DOUBLE AS relevance,
       CASE WHEN NOT audited THEN 'not_in_audited_auto_roles' WHEN family = 'defect' AND NOT (loc OR (str AND NOT off)) THEN 'defect_prompt_requires_localization_task'
         WHEN family <> 'object' AND NOT (loc OR str) THEN 'part_prompt_requires_localization_description_or_analysis' END AS no FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY no IS NOT NULL, relevance DESC, ord, role) AS place FROM r)
    SELECT p_partkey AS request_id, role, family, relevance, CASE WHEN no IS NULL AND place <= 4 THEN 'selected' ELSE 'rejected' END AS status,
      CASE WHEN no IS NULL AND place <= 4 THEN CASE WHEN family = 'defect' AND loc THEN 'selected_defect_prompt_for_localization' WHEN family = 'defect' THEN 'selected_defect_prompt_for_defect_qa' WHEN family = 'object' THEN 'selected_object_prompt'
         WHEN str THEN 'selected_audited_part_for_structural_task' ELSE 'selected_audited_part_for_localization' END ELSE coalesce(no, 'ranked_below_prompt_budget') END AS reason FROM o""",
)
def prompt_plan(spark, folder):
    part, size = F.col("p_partkey"), F.col("p_size")
    prompts = table(spark, folder, "part").select(
        part.alias("request_id"), _pick(PLAN_TASKS, part % 4).alias("task_type"), "p_size", F.posexplode(T.words(ROLES)).alias("profile_order", "role")
    )
    prompts = prompts.select(
        "request_id", "task_type", "role", "profile_order", ((size + F.col("profile_order")) % 5 != 0).alias("audited"), (size % 6 == 0).alias("defect_disabled")
    )
    return R.prompt_plan(prompts, "request_id", top=4).select("request_id", "role", "family", "relevance", "status", "reason")


@query(
    "win11_loaded_profiles",
    f"""WITH b AS (SELECT p_type AS dataset, p_brand AS category, p_size % 9 AS k, bool_or(p_partkey % 4 <> 0) AS audited FROM part GROUP BY ALL),
    prof AS (SELECT dataset, category, {_sql_pick(ROLES, 'k')} AS role, CAST(row_number() OVER (PARTITION BY dataset, category ORDER BY k) - 1 AS INTEGER) AS ord, audited, ends_with(category, '1') AS off, 0.3::DOUBLE + k * 0.05::DOUBLE AS threshold FROM b),
    p AS (SELECT p_partkey, {_sql_pick(PLAN_TASKS, 'p_partkey % 4')} AS task, ord, role, audited, off, threshold FROM part JOIN prof ON dataset = p_type AND category = p_brand),
    """
    + PLAN_SQL
    + """ SELECT p_partkey AS request_id, role, round(threshold, 6) AS threshold, relevance, CASE WHEN no IS NULL AND place <= 4 THEN 'selected' ELSE 'rejected' END AS status,
      CASE WHEN no IS NULL AND place <= 4 THEN yes ELSE coalesce(no, 'ranked_below_prompt_budget') END AS reason FROM o""",
)
def loaded_profiles(spark, folder):
    """Prompt plans from profile documents: written one per type and brand, read back, joined to the requests."""
    part = table(spark, folder, "part")
    kinds = part.groupBy(F.col("p_type").alias("dataset"), F.col("p_brand").alias("category"), (F.col("p_size") % 9).cast("int").alias("k")).agg(
        F.bool_or(F.col("p_partkey") % 4 != 0).alias("audited")
    )
    role = _pick(ROLES, F.col("k"))
    prompt = F.struct(F.col("k"), role.alias("role"), F.concat_ws(" ", F.lit("the"), role).alias("text"), (F.col("k") * 0.05 + 0.3).alias("threshold"))
    docs = kinds.groupBy("dataset", "category").agg(  # nine prompts at most
        F.transform(F.array_sort(F.collect_list(prompt)), lambda p: p.dropFields("k")).alias("prompts"), F.collect_set(F.when(F.col("audited"), role)).alias("audited_roles")
    )
    text = F.to_json(F.struct("dataset", "category", (~F.col("category").endswith("1")).alias("defect_prompts"), "audited_roles", "prompts"))
    path = shared_path(spark, "profiles")
    sinks.write_documents(docs.select(F.col("dataset").alias("folder"), text.alias("text")), path, ["folder"])
    profiles = documents.prompt_profiles(documents.read_json_files(spark, path))
    requests = part.select(F.col("p_partkey").alias("request_id"), F.col("p_type").alias("dataset"), F.col("p_brand").alias("category"), _pick(PLAN_TASKS, F.col("p_partkey") % 4).alias("task_type"))
    plan = R.prompt_plan(attach(requests, profiles, ["dataset", "category"]), "request_id", top=4)
    return plan.select("request_id", "role", F.round("threshold", 6).alias("threshold"), "relevance", "status", "reason")


@query(
    "win13_visible_crops",
    "WITH "
    + BOXES_SQL
    + """, c AS (SELECT image_id, box_id AS slot, CASE WHEN image_id % 3 = 0 THEN 'object details' ELSE 'defect analysis' END AS task, CASE source WHEN 'box' THEN 'heatmap_proposal' WHEN 'text' THEN 'sam3_text' ELSE CASE WHEN image_id % 5 = 0 THEN 'other' ELSE 'mcts_node' END END AS src,
       CASE WHEN source = 'box' THEN CASE WHEN line % 2 = 0 THEN 'strict' ELSE 'weak_pixel_threshold_fallback' END END AS psrc, CASE WHEN line > 3 THEN 'defect_hole' ELSE 'defect_stain' END AS role, 0.85::DOUBLE + discount AS ms, tax * 6 AS ratio FROM boxes),
    f AS (SELECT *, bool_or(src = 'heatmap_proposal' AND psrc = 'strict') OVER w AS strict_, bool_or(src = 'heatmap_proposal' AND psrc LIKE 'weak%') OVER w AS weak_, count(*) FILTER (src = 'mcts_node') OVER w AS nodes, min(slot) OVER w AS first_, CASE WHEN image_id % 3 = 0 THEN 3 ELSE 2 END AS most FROM c WINDOW w AS (PARTITION BY image_id)),
    t AS (SELECT *, weak_ AND NOT strict_ AS ow, CASE WHEN weak_ AND NOT strict_ THEN CASE WHEN src = 'heatmap_proposal' THEN 'pixel_threshold_heatmap_fallback_crop' END WHEN src = 'mcts_node' THEN 'mcts_focus_after_strict_contour'
        WHEN nodes = 0 AND src = 'heatmap_proposal' THEN 'strict_heatmap_proposal_fallback_when_mcts_missing' END AS why, src = 'sam3_text' AND role = 'defect_hole' AND ms >= 0.9::DOUBLE AND ratio <= 0.35::DOUBLE AS mask FROM f),
    u AS (SELECT *, CASE WHEN why IS NOT NULL THEN 1 WHEN mask THEN 2 ELSE 3 END AS tier FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY image_id, tier ORDER BY slot) AS nth FROM u),
    l AS (SELECT *, count(*) FILTER (tier = 1 AND nth <= CASE WHEN ow OR nodes = 0 THEN 1 ELSE most END) OVER (PARTITION BY image_id) AS taken FROM n),
    s AS (SELECT *, (tier = 1 AND nth <= CASE WHEN ow OR nodes = 0 THEN 1 ELSE most END) OR (tier = 2 AND nth <= most - taken) AS shown FROM l), a AS (SELECT *, bool_or(shown) OVER (PARTITION BY image_id) AS any_ FROM s)
    SELECT image_id, slot AS crop_at, CASE WHEN shown AND tier = 1 THEN why WHEN shown THEN 'high_confidence_structural_sam3_text_mask' ELSE 'fallback_first_selected_candidate' END AS prompt_reason FROM a WHERE shown OR (NOT any_ AND slot = first_)""",
)
def visible_crops(spark, folder):
    image, line = F.col("image_id"), F.col("line")
    searched = F.when(image % 5 == 0, "other").otherwise("mcts_node")
    crops = boxes(spark, folder).select(
        "image_id",
        F.col("box_id").alias("at"),
        F.when(image % 3 == 0, "object details").otherwise("defect analysis").alias("task_type"),
        F.when(F.col("source") == "box", "heatmap_proposal").when(F.col("source") == "text", "sam3_text").otherwise(searched).alias("source"),
        F.when(F.col("source") == "box", F.when(line % 2 == 0, "strict").otherwise("weak_pixel_threshold_fallback")).alias("proposal_source"),
        F.when(line > 3, "defect_hole").otherwise("defect_stain").alias("prompt_role"),
        (F.col("discount") + 0.85).alias("mask_score"),
        F.lit(True).alias("mask_accepted"),
        (F.col("tax") * 6).alias("bbox_area_ratio"),
    )
    return R.visible_crops(crops, "image_id").select("image_id", F.col("at").alias("crop_at"), "prompt_reason")


@query(
    "trc1_method_trace",
    "WITH "
    + SCORES_SQL
    + """, t AS (SELECT image_path, CAST(score > 40 AS INTEGER) AS tp, CAST(ordinal % 3 = 0 AS INTEGER) AS vp FROM scores WHERE split = 'test')
    SELECT image_path, CASE WHEN tp + vp > 0 THEN 1 ELSE 0 END AS prediction, CASE WHEN tp + vp > 0 THEN 'anomaly' ELSE 'normal' END AS prediction_text, CASE WHEN vp = 1 THEN 'anomaly' ELSE 'normal' END AS verifier_text,
      'anomaly_or:external' AS policy, 'unknown' AS threshold_source, 'N/A' AS phase_1_result, length('prompt ' || image_path) AS prompt_length, tp AS threshold_prediction FROM t""",
)
def method_trace(spark, folder):
    rows = scores(spark, folder).where("split = 'test'").select(
        "image_path", "score", (F.col("score") > 40).cast("int").alias("tp"), (F.col("ordinal") % 3 == 0).cast("int").alias("vp")
    )
    trace = TR.method_trace(
        {"heatmap_score": F.col("score"), "image": F.col("image_path")},
        prompt=F.concat(F.lit("prompt "), "image_path"),
        response=F.lit(None).cast("string"),
        level="full",
    )
    final = F.greatest("tp", "vp")
    rows = rows.withColumn("trace", TR.with_verifier(trace, threshold=F.col("tp"), verifier=F.col("vp"), final=final, policy="anomaly_or", name=F.lit("external")))
    return rows.select(
        "image_path",
        F.col("trace.prediction").alias("prediction"),
        F.col("trace.final_decision.prediction_text").alias("prediction_text"),
        F.col("trace.final_decision.verifier_prediction_text").alias("verifier_text"),
        F.col("trace.final_decision.policy").alias("policy"),
        F.col("trace.threshold_source").alias("threshold_source"),
        F.col("trace.phase_1_result").alias("phase_1_result"),
        F.length("trace.final_prompt").cast("long").alias("prompt_length"),
        F.col("trace.threshold_decision.prediction").alias("threshold_prediction"),
    )


@query(
    "txt15_attribute_evidence",
    "WITH "
    + KB_SQL
    + f""", q AS (SELECT p_partkey, i, substr('ABCD', CAST(i + 1 AS INTEGER), 1) AS option_key, p_partkey % 12 AS doc_id, (p_partkey * (1 + i % 3) + i * 3 + p_size) % 12 AS oid FROM part, (SELECT unnest(range(4)) AS i)),
    reports AS (SELECT CAST(i AS BIGINT) AS doc_id, {_sql_pick(REPORTS, 'i')} AS report FROM (SELECT unnest(range(12)) AS i)), phrases AS (SELECT CAST(i AS BIGINT) AS oid, {_sql_pick(OPTIONS, 'i')} AS txt FROM (SELECT unnest(range(12)) AS i)),
    """
    + NORMAL_SQL
    + ", pairs AS (SELECT doc_id, oid FROM reports, phrases), variants AS (SELECT row_number() OVER (ORDER BY t) AS vid, t FROM (SELECT DISTINCT type || ' ' || signature || ' ' || coalesce(array_to_string(attributes, ' '), '') || ' ' || coalesce(target_defect, '') || ' ' || coalesce(difference, '') AS t FROM kb_defects)), "
    + S.LEXICON
    + ", "
    + ", ".join(
        [
            S.tokens("lt", "reports", "doc_id", "report"),
            S.tokens("rt", "phrases", "oid", "txt"),
            S.tokens("vt", "variants", "vid", "t"),
            S.hits("lh", "lt", "doc_id"),
            S.hits("rh", "rt", "oid"),
            S.hits("vh", "vt", "vid"),
            S.shared("sh", "pairs", "lt", "doc_id", "rt", "oid"),
            S.overlap("ov", "pairs", "lh", "doc_id", "rh", "oid"),
        ]
    )
    + """, sc AS (SELECT p.doc_id, p.oid, coalesce(strong, 0) AS strong, coalesce(weak, 0) AS weak, coalesce(attrs, 0) AS attrs, coalesce(terms, 0) AS terms FROM pairs p LEFT JOIN sh USING (doc_id, oid) LEFT JOIN ov USING (doc_id, oid)),
    rated AS (SELECT *, 1.2::DOUBLE * strong + 1.35::DOUBLE * attrs + 0.18::DOUBLE * terms AS signal, 1.2::DOUBLE * strong + 1.35::DOUBLE * attrs + 0.18::DOUBLE * terms + 0.25::DOUBLE * weak AS score FROM sc WHERE """
    + S.consensus(["(strong > 0)", "(attrs > 0)"], "(attrs > 0)", None, "terms")
    + """),
    support AS (SELECT DISTINCT d.p_partkey, vh.attr FROM kb_defects d JOIN variants v ON v.t = type || ' ' || signature || ' ' || coalesce(array_to_string(attributes, ' '), '') || ' ' || coalesce(target_defect, '') || ' ' || coalesce(difference, '') JOIN vh USING (vid) WHERE (d.p_partkey + d.pos) % 4 <> 0),
    cand AS (SELECT q.p_partkey, q.option_key, r.score, r.signal, string_agg(a.attr, ',' ORDER BY a.attr) AS attrs FROM q JOIN rated r ON r.doc_id = q.doc_id AND r.oid = q.oid JOIN verdict v ON v.doc_id = q.doc_id AND NOT (phrase AND NOT affirmed)
      JOIN ov_a a ON a.doc_id = q.doc_id AND a.oid = q.oid JOIN support s ON s.p_partkey = q.p_partkey AND s.attr = a.attr WHERE r.signal >= 2.0 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER w AS rn, round(score, 6) - lead(round(score, 6)) OVER w AS ahead FROM cand WINDOW w AS (PARTITION BY p_partkey ORDER BY round(score, 6) DESC, option_key))
    SELECT p_partkey AS question_id, option_key, attrs AS supported, round(score, 4) AS score, ahead IS NULL OR round(ahead, 6) >= 0.55::DOUBLE AS decisive FROM o WHERE rn = 1""",
)
def attribute_evidence(spark, folder):
    """Best option by report evidence, counting only attributes that a source-backed defect shows."""
    from plumbline.plans.evidence import options

    number = F.regexp_extract("category", r"(\d+)$", 1).cast("long")
    known = defects(spark, folder).where((number + F.floor(F.col("defect_order") / 2)) % 4 != 0)
    rows = options(spark, folder).withColumn("report", _pick(REPORTS, F.col("question_id") % 12))
    out = graph_supported(rows, known)
    return out.select(
        "question_id", "option_key", F.array_join("supported", ",").alias("supported"), F.round("score", 4).alias("score"), "decisive"
    )


def graph_supported(rows, backed_defects, *, min_signal: float = 2.0, margin: float = 0.55):
    """``rows``: question_id, category, option_key, option_text, report; ``backed_defects`` of source-backed regions."""
    text = E.evidence_text(
        name=F.col("defect"), signature=F.col("visual_signature"), attributes=F.col("visual_attributes"), distinctions=F.col("distinctions")
    )
    stated = backed_defects.select("category", text.alias("_e")).distinct()
    # each text is read once, however many categories state it
    shown = words.profiles(stated.select("_e").distinct(), ["_e"], evidence="_e").select("_e", F.explode(F.map_keys("evidence_attrs")).alias("attr"))
    support = meet(stated, shown, ["_e"]).select("category", "attr").distinct()
    support = support.groupBy("category").agg(F.array_sort(F.collect_list("attr")).alias("attrs"))
    told = rows.select("report").distinct().withColumn("_n", T.normalize_text(F.col("report")))
    told = told.withColumn("_w", T.ordered_tokens("_n"))
    told = told.withColumn("_normal", T.reports_normal(F.col("_n"), F.col("_w")))
    texts = E.hold(told.select("report", "_normal")).where(~F.col("_normal")).select("report")
    pairs = meet(rows.select("report", "option_text").distinct(), texts, ["report"])
    scored = E.score_pairs(E.profiled(pairs, report="report", option="option_text"), "report", "option")
    scored = scored.where(F.col("evidence_consensus") & (F.col("signal_score") >= min_signal)).select(
        "report", "option_text", F.round("score", 6).alias("score"), "signal_score", F.array_sort(F.map_keys("attribute_overlap")).alias("shared")
    )
    found = meet(meet(rows, scored, ["report", "option_text"]), support, ["category"])
    found = found.withColumn("supported", F.array_intersect("shared", "attrs")).where(F.size("supported") > 0)
    return E.decisive(found, ["question_id"], [F.desc("score"), F.asc("option_key")], margin - 1e-9)

"""Region retrieval plans, provenance checks and the choice of what a prompt shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.boxes import is_structural_role
from plumbline.operators.joins import attach, meet

# What counts as a trusted source of knowledge and of visual references.
KNOWLEDGE_SOURCE = "text_knowledge_json"
REFERENCE_SOURCE = "normal_reference_region_cutouts"
GENERATION_WORDS = "sam3|segmentation|direct-copy|direct copy"
FAMILY_PRIORS = {
    "localization": {"defect": 3.0, "part": 2.0, "object": 1.0},
    "structural": {"defect": 3.0, "part": 2.0, "object": 2.0},
    "semantic": {"defect": 3.0, "object": 2.0, "part": 1.0},
    "generic": {"object": 1.0, "part": 0.75, "defect": 0.5},
}
OBJECT_ROLES = ["whole", "whole_object", "whole_board", "target_object"]
WEAK_SOURCES = ["weak_pixel_threshold_fallback", "weak_ranked_tail_fallback"]
TWO_CROP_TASKS = [
    "defect localization",
    "defect classification",
    "defect description",
    "defect analysis",
    "anomaly detection",
]


def plan_regions(requests: DataFrame, regions: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Regions of each request with selection flag, order and reasons.

    ``requests``: request_id, category, mode, top_k, has_query, include_global. ``regions``:
    category, region, pos, critical_check. ``similarity`` is computed from both sides' columns; the ``top_k`` most similar regions of a request
    (ties by pos) are its semantic ones. Modes: full, semantic_topk, hybrid; without a query or
    with top_k 0 every region is taken, and an empty selection falls back to the first ones.

    Ranks, counts and orders are windows over one request, so a request's few regions meet once. Other columns than those named are dropped before that.
    """
    keep = ["request_id", "category", "mode", "top_k", "has_query", "include_global"]
    value = F.lit(None).cast("double") if similarity is None else F.round(similarity, 9)
    rows = meet(requests, regions, ["category"]).select(*keep, "region", "pos", "critical_check", value.alias("_similarity"))
    per_request = W.partitionBy("request_id")
    rank = F.row_number().over(per_request.orderBy(F.desc_nulls_last("_similarity"), "pos"))
    rows = rows.withColumn("rank", F.when(F.col("_similarity").isNotNull(), rank)).drop("_similarity")
    asked = F.col("has_query") & (F.col("top_k") > 0)
    mode = F.lower(F.coalesce("mode", F.lit("full")))
    whole = F.col("include_global") & T.is_global_region(F.col("region"))
    critical = T.is_valid(F.col("critical_check")) & (F.trim("critical_check") != "")
    near = F.coalesce(F.col("rank") <= F.col("top_k"), F.lit(False)) & asked
    full = ~(asked & mode.isin("semantic_topk", "hybrid"))
    tier = (
        F.when(full, F.struct(F.lit(0).alias("tier"), F.col("pos").alias("at")))
        .when(whole, F.struct(F.lit(0).alias("tier"), F.col("pos").alias("at")))
        .when((mode == "hybrid") & critical, F.struct(F.lit(1).alias("tier"), F.col("pos").alias("at")))
        .when(near, F.struct(F.lit(2).alias("tier"), F.col("rank").alias("at")))
    )
    rows = rows.withColumns({"_tier": tier, "_full": full, "_whole": whole, "_critical": critical, "_near": near})
    rows = rows.withColumns({"_chosen": F.count("_tier").over(per_request), "_place": F.row_number().over(per_request.orderBy("pos"))})
    limit = F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(F.lit(2**31 - 1))
    rows = rows.withColumn("_fallback", (F.col("_chosen") == 0) & (F.col("_place") <= limit))
    rows = rows.withColumn("_tier", F.coalesce("_tier", F.when(F.col("_fallback"), F.struct(F.lit(3).alias("tier"), F.col("pos").alias("at")))))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_whole"), "global_or_whole_standard"),
            F.when(F.col("_critical"), "critical_check_available"),
            F.when(F.col("_near"), F.concat(F.lit("semantic_rank_"), F.col("rank").cast("string"))),
            F.when(F.col("_full"), "full_graph_context"),
            F.when(F.col("_fallback"), "fallback_region_order"),
        )
    )
    order = F.row_number().over(per_request.orderBy(F.asc_nulls_last("_tier.tier"), "_tier.at", "pos"))
    selected = F.col("_tier").isNotNull()
    return rows.select(
        *keep,
        "region",
        "pos",
        selected.alias("selected"),
        F.when(selected, order).alias("selected_order"),
        reasons.alias("reasons"),
    )


def reason_counts(plan: DataFrame) -> DataFrame:
    """Per request, reason=count of its selected regions in name order."""
    rows = plan.where("selected").select("request_id", F.explode("reasons").alias("reason"))
    counts = rows.groupBy("request_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws("=", "reason", F.col("n").cast("string"))
    return counts.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("reason_counts"))


def is_trusted_reference(source: Column, generation: Column) -> Column:
    made = F.lower(F.trim(F.coalesce(generation, F.lit(""))))
    return (
        (F.trim(F.coalesce(source, F.lit(""))) == REFERENCE_SOURCE)
        & (made.contains("normal") | made.contains("reference"))
        & made.rlike(GENERATION_WORDS)
    )


def trust_audit(references: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Path counts and source backing. ``references``: key, source, generation, path (null for none)."""
    seen = manifest.select("path").distinct().withColumn("_seen", F.lit(True))
    paths = references.where(F.coalesce("path", F.lit("")) != "")
    counted = (
        paths.join(seen, "path", "left")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("path_count"), F.count("_seen").alias("existing_path_count"))
    )
    base = references.select(*key, is_trusted_reference(F.col("source"), F.col("generation")).alias("trusted_source")).distinct()
    out = base.join(counted, key, "left").fillna(0, ["path_count", "existing_path_count"])
    complete = (F.col("path_count") > 0) & (F.col("existing_path_count") == F.col("path_count"))
    return out.withColumns(
        {
            "missing_path_count": F.col("path_count") - F.col("existing_path_count"),
            "source_backed": F.col("trusted_source") & complete,
        }
    )


def _same_path(a: Column, b: Column) -> Column:
    def clean(p):
        out = F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"/+", "/")
        return F.regexp_replace(out, r"(?<=.)/$", "")

    return F.coalesce((a != "") & (b != "") & (clean(a) == clean(b)), F.lit(False))


def metadata_checks(metadata: dict[str, Column], expected: dict[str, Column]) -> dict[str, Column]:
    """Ten checks of graph source metadata against what is expected."""
    m = {k: F.coalesce(v, F.lit("")) for k, v in metadata.items()}
    known = (m["knowledge_source_type"] == KNOWLEDGE_SOURCE) | (m["source_type"] == KNOWLEDGE_SOURCE)
    return {
        "present": F.lit(True),
        "dataset_matches": F.lower(m["dataset"]) == F.lower(expected["dataset"]),
        "category_matches": m["category"] == expected["category"],
        "knowledge_source_type_trusted": known,
        "source_json_matches": _same_path(m["source_json_path"], expected["source_json_path"]),
        "visual_reference_root_matches": _same_path(m["visual_reference_root"], expected["visual_reference_root"]),
        "visual_reference_source_trusted": m["visual_reference_source"] == REFERENCE_SOURCE,
        "visual_reference_generation_trusted": is_trusted_reference(
            m["visual_reference_source"], m["visual_reference_generation"]
        ),
        "builder_recorded": F.trim(m["visual_reference_builder"]) != "",
        "graph_output_root_matches": _same_path(m["graph_output_root"], expected["graph_output_root"]),
    }


def knowledge_path(requests: DataFrame, manifest: DataFrame, roots: list[str]) -> DataFrame:
    """All existing knowledge files per request in candidate order; a recorded source that exists is the only one.

    ``requests``: request_id, subclass, recorded_path, graph_root (its name starts with graph_index).
    """
    own = F.when(
        F.startswith("graph_root", F.lit("graph_index")),
        F.concat(F.lit("text_knowledge"), F.expr("substring(graph_root, length('graph_index') + 1)")),
    )
    folders = F.array_distinct(F.array_compact(F.array(own, *[F.lit(r) for r in roots])))
    sets = F.array(F.lit("mvtec"), F.lit("visa"))
    paths = F.flatten(
        F.transform(
            folders, lambda r: F.transform(sets, lambda s: F.concat_ws("/", r, s, F.concat("subclass", F.lit(".json"))))
        )
    )
    rows = requests.select("request_id", F.posexplode(F.concat(F.array("recorded_path"), paths)).alias("at", "path"))
    found = rows.where("path is not null").join(manifest.select("path").distinct(), "path", "left_semi")
    firsts = found.groupBy("request_id", "path").agg(F.min("at").alias("at"))
    listed = firsts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("p"))
    recorded = F.get("p", F.lit(0))["at"] == 0
    return listed.select("request_id", F.when(recorded, F.slice("p", 1, 1)["path"]).otherwise(F.col("p")["path"]).alias("paths"))


def select_blocks(blocks: DataFrame, hypotheses: DataFrame, key: str) -> DataFrame:
    """Prompt-visible blocks: global regions and those a local hypothesis names, else all of them.

    ``blocks``: key, region, prompt_visible. ``hypotheses``: key, region. Adds ``mode``.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", "_")
    local = hypotheses.where(~T.is_global_region(F.col("region")) & (norm(F.col("region")) != ""))
    local = local.groupBy(key).agg(F.collect_set(norm(F.col("region"))).alias("_local"))
    rows = blocks.where(F.coalesce("prompt_visible", F.lit(True))).withColumn("_norm", norm(F.col("region")))
    rows = meet(rows, local, [key], "left")
    rows = rows.withColumn("_keep", F.coalesce(F.array_contains("_local", F.col("_norm")), F.lit(False)) | T.is_global_region(F.col("region")))
    rows = rows.withColumn("_kept", F.count_if("_keep").over(W.partitionBy(key)))
    mode = (
        F.when(F.col("_local").isNull(), "full_fallback_no_local_hypothesis")
        .when(F.col("_kept") == 0, "full_fallback_unmatched_hypothesis")
        .otherwise("hypothesis_region_filter")
    )
    rows = rows.withColumn("mode", mode)
    return rows.where((F.col("mode") != "hypothesis_region_filter") | F.col("_keep")).select(*blocks.columns, "mode")


def supported_hypotheses(hypotheses: DataFrame, backing: DataFrame, supported_paths: DataFrame, keys: list[str]) -> DataFrame:
    """Hypotheses whose region is source-backed and whose graph path an option supports.

    ``backing``: category, region, graph_path, source_path, text_paths. ``supported_paths``: keys, graph_path.
    """
    has_graph = F.coalesce("graph_cache_path", F.lit("")) != ""
    has_text = (F.coalesce("source_json_path", F.lit("")) != "") | (F.coalesce("text_path_count", F.lit(0)) > 0)
    backed = backing.where(has_graph & has_text).select("category", "region").distinct()
    rows = meet(hypotheses, backed, ["category", "region"], "left_semi")
    return meet(rows, supported_paths, [*keys, "graph_path"], "left_semi")


def role_family(role: Column) -> Column:
    return F.when(role.isin(OBJECT_ROLES), "object").when(F.startswith(role, F.lit("defect_")), "defect").otherwise("part")


def prompt_plan(prompts: DataFrame, key: str, *, top: int = 6, include_parts: bool = True) -> DataFrame:
    """Rank and audit a request's prompts by task.

    ``prompts``: key, task_type, role, profile_order, audited, defect_disabled (whether
    defect prompts are off for the category outside localization). Adds family, relevance,
    status and reason.
    """
    task = F.lower(F.coalesce("task_type", F.lit("")))
    loc, struct = task.contains("localization"), task.contains("description") | task.contains("analysis")
    mode = (
        F.when(loc, "localization")
        .when(struct, "structural")
        .when(task.contains("classification") | task.contains("detection"), "semantic")
        .otherwise("generic")
    )
    priors = F.create_map(
        *[F.lit(x) for m, fam in FAMILY_PRIORS.items() for f, v in fam.items() for x in (f"{m}/{f}", v)]
    )
    family = role_family(F.col("role"))
    rows = prompts.withColumns({"family": family, "relevance": F.element_at(priors, F.concat_ws("/", mode, family))})
    defect, object_ = F.col("family") == "defect", F.col("family") == "object"
    allows_defect = loc | ((task.contains("classification") | struct) & ~F.col("defect_disabled"))
    refused = (
        F.when(~F.col("audited"), "not_in_audited_auto_roles")
        .when(~object_ & F.lit(not include_parts), "part_prompts_disabled")
        .when(defect & ~allows_defect, "defect_prompt_requires_localization_task")
        .when(~object_ & ~(loc | struct), "part_prompt_requires_localization_description_or_analysis")
    )
    reason = (
        F.when(defect & loc, "selected_defect_prompt_for_localization")
        .when(defect, "selected_defect_prompt_for_defect_qa")
        .when(object_, "selected_object_prompt")
        .when(struct, "selected_audited_part_for_structural_task")
        .otherwise("selected_audited_part_for_localization")
    )
    rows = rows.withColumns({"_no": refused, "_yes": reason})
    place = F.row_number().over(
        W.partitionBy(key).orderBy(F.col("_no").isNotNull(), F.desc("relevance"), "profile_order", "role")
    )
    rows = rows.withColumn("_place", place)
    chosen = F.col("_no").isNull() & (F.col("_place") <= top)
    return rows.select(
        *prompts.columns,
        "family",
        "relevance",
        F.when(chosen, "selected").otherwise("rejected").alias("status"),
        F.when(chosen, F.col("_yes")).otherwise(F.coalesce("_no", F.lit("ranked_below_prompt_budget"))).alias("reason"),
        F.when(chosen, F.col("_place")).alias("selected_order"),
    )


def visible_crops(crops: DataFrame, key: str) -> DataFrame:
    """Crops a prompt shows. ``crops``: key, at (position), task_type, source, proposal_source,
    prompt_role, mask_score, mask_accepted, bbox_area_ratio.

    Only a weak heatmap fallback: one such crop. Otherwise search crops up to the task's limit,
    or one heatmap crop when there are none. High-confidence structural masks fill what is left;
    with nothing chosen the first crop is shown.
    """
    heat = F.col("source") == "heatmap_proposal"
    weak = heat & F.col("proposal_source").isin(WEAK_SOURCES)
    flags = crops.groupBy(key).agg(
        F.bool_or(heat & (F.coalesce("proposal_source", F.lit("")) == "strict")).alias("_strict"),
        F.bool_or(F.coalesce(weak, F.lit(False))).alias("_weak"),
        F.count_if(F.col("source") == "mcts_node").alias("_nodes"),
        F.count_if(heat).alias("_heats"),
        F.min("at").alias("_first"),
    )
    rows = crops.join(flags, key)
    only_weak = F.col("_weak") & ~F.col("_strict")
    most = F.when(F.lower("task_type").isin(TWO_CROP_TASKS), 2).otherwise(3)
    structural = (
        (F.col("source") == "sam3_text")
        & is_structural_role(F.col("prompt_role"))
        & (F.col("mask_score") >= 0.90)
        & F.col("mask_accepted")
        & (F.col("bbox_area_ratio") <= 0.35)
    )
    primary = (
        F.when(only_weak & weak, "pixel_threshold_heatmap_fallback_crop")
        .when(~only_weak & (F.col("source") == "mcts_node"), "mcts_focus_after_strict_contour")
        .when(~only_weak & (F.col("_nodes") == 0) & heat, "strict_heatmap_proposal_fallback_when_mcts_missing")
    )
    rows = rows.withColumns({"_why": primary, "_mask": F.coalesce(structural, F.lit(False)), "_most": most, "_only_weak": only_weak})
    tier = F.when(F.col("_why").isNotNull(), 1).when(F.col("_mask"), 2).otherwise(3)
    rows = rows.withColumn("_tier", tier)
    nth = F.row_number().over(W.partitionBy(key, "_tier").orderBy("at"))
    per_first = F.when(F.col("_only_weak") | (F.col("_nodes") == 0), 1).otherwise(F.col("_most"))
    rows = rows.withColumn("_nth", nth).withColumn("_taken", F.count_if((F.col("_tier") == 1) & (F.col("_nth") <= per_first)).over(W.partitionBy(key)))
    shown = ((F.col("_tier") == 1) & (F.col("_nth") <= per_first)) | (
        (F.col("_tier") == 2) & (F.col("_nth") <= F.col("_most") - F.col("_taken"))
    )
    rows = rows.withColumn("_shown", shown).withColumn("_any", F.max("_shown").over(W.partitionBy(key)))
    reason = (
        F.when(F.col("_shown") & (F.col("_tier") == 1), F.col("_why"))
        .when(F.col("_shown"), "high_confidence_structural_sam3_text_mask")
        .when(~F.col("_any") & (F.col("at") == F.col("_first")), "fallback_first_selected_candidate")
    )
    return rows.withColumn("prompt_reason", reason).where("prompt_reason is not null").select(*crops.columns, "prompt_reason")

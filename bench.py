"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "cal4_robust_threshold",
    "dec1_threshold_decision",
    "agg4_category_summary",
    "agg5_pipeline_summary",
    "agg3_accuracy_rollup",
    "agg8_image_auroc",
    "agg10_pixel_auroc",
    "win1_normal_references",
    "src3_resolved_paths",
    "src6_layout_samples",
    "src9_folder_metadata",
    "src18_earlier_results",
    "jn2_resumed_predictions",
    "txt10_verifier_response",
    "geo1_image_boxes",
    "jn6_best_overlap",
    "win4_greedy_selection",
    "win5_final_nodes",
    "win15_tiered_fill",
    "agg12_search_trace",
    "sco1_tail_mean",
    "sco6_nearest_distance",
    "sco13_class_moments",
    "win10_similar_top_k",
    "reg2_components",
    "agg11_region_overlap_area",
    "dec3_answer_override",
    "dec10_completeness",
    "txt2_token_sets",
    "txt5_pair_scores",
    "txt8_normal_reports",
    "win7_ranked_defects",
    "txt7_ranked_hypotheses",
    "grf1_graph_edges",
    "rag1_retrieval_plan",
    "rag3_trust_audit",
    "udf1_scored_images",
]


def main() -> None:
    from plumbline.plans import QUERIES, load_all
    from plumbline.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    load_all()
    if names == ["all"]:
        names = list(QUERIES)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).replace("sf", "")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()

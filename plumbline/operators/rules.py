"""Decision rules over tables of measured parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import arrays as A

# Expected colour per position, in reporting order.
EXPECTED_COLORS = [("Center Top", "YELLOW"), ("Center Left", "BLUE"), ("Center Right", "BROWN")]


def normal_part_veto(
    rows: DataFrame,
    key: str,
    *,
    min_score: float = 0.80,
    min_area: float = 0.03,
    max_area: float = 0.18,
    advantage: float = 0.12,
) -> DataFrame:
    """Veto when a normal part's mask is convincing and beats every accepted defect mask by a margin.

    ``rows``: key, role ("normal" or a defect role), score, area_ratio, accepted, ordinal.
    """
    normal = F.min(
        F.when(F.col("role") == "normal", F.struct("ordinal", "score", "area_ratio", "accepted"))
    )
    defect = F.when((F.col("role") != "normal") & F.col("accepted"), F.col("score"))
    out = rows.groupBy(key).agg(normal.alias("_n"), F.coalesce(F.max(defect), F.lit(0.0)).alias("best_defect_score"))
    passed = F.coalesce(
        F.col("_n.accepted") & (F.col("_n.score") >= min_score) & F.col("_n.area_ratio").between(min_area, max_area), F.lit(False)
    )
    veto = F.coalesce(passed & (F.col("_n.score") >= F.col("best_defect_score") + advantage), F.lit(False))
    return out.select(
        key,
        passed.alias("normal_passed"),
        F.round("best_defect_score", 6).alias("best_defect_score"),
        veto.alias("veto_yes_to_no"),
        F.when(veto, "normal_part_mask_beats_competing_defect_masks")
        .when(~passed, "normal_part_mask_not_confident")
        .otherwise("competing_defect_mask_not_sufficiently_lower")
        .alias("reason"),
    )


def width_profile(masks: DataFrame, *, min_rows: int = 50, narrow: float = 0.88, wide: float = 1.20) -> DataFrame:
    """Rows of a mask much narrower or wider than its trimmed median width. ``masks``: image_id, height, width, mask."""
    widths = F.transform(
        F.sequence(F.lit(0), F.col("height") - 1),
        lambda y: F.size(F.filter(F.slice("mask", y * F.col("width") + 1, F.col("width")), lambda m: m)),
    )
    rows = masks.select("image_id", widths.alias("all"))
    rows = rows.withColumn("lit", F.array_compact(F.transform("all", lambda v, i: F.when(v > 0, i))))
    top, bottom = F.array_min("lit"), F.array_max("lit")
    box = F.slice("all", top + 1, bottom - top + 1)
    rows = rows.where(F.size("lit") > 0).select("image_id", box.alias("box"), F.size("lit").alias("n"))
    rows = rows.withColumn("valid", F.filter("box", lambda v: v > 0))
    start, end = F.floor(F.col("n") * 0.1).cast("int"), F.floor(F.col("n") * 0.9).cast("int")
    rows = rows.withColumn("median_width", A.median(F.slice("valid", start + 1, end - start)))
    size = F.size("box")
    inner = F.array_compact(
        F.transform("box", lambda v, i: F.when((v > 0) & (i >= size * 0.05) & (i <= size * 0.95), v))
    )
    rows = rows.withColumn("inner", inner)
    split = F.exists("inner", lambda v: v > F.col("median_width") * wide)
    squeezed = F.exists("inner", lambda v: v < F.col("median_width") * narrow)
    return rows.select(
        "image_id",
        F.when(F.col("n") >= min_rows, F.col("median_width")).alias("median_width"),
        F.when(F.col("n") < min_rows, "too_short").when(split, "split").when(squeezed, "squeezed").otherwise("normal").alias("verdict"),
    )


def color_class(h: Column, s: Column, v: Column) -> Column:
    """Colour name from mean hue (0-180), saturation and value (0-255)."""
    return (
        F.when(v < 30, "VOID")
        .when(s < 45, "BROWN")
        .when((h > 95) & (h < 155), "BLUE")
        .when((h > 15) & (h <= 95), "YELLOW")
        .otherwise("BROWN")
    )


def positional_check(found: DataFrame, key: str) -> DataFrame:
    """Missing positions, else swapped ones. ``found``: key, position, color (one row per position)."""
    expected = F.array(
        *[
            F.struct(F.lit(i).alias("at"), F.lit(p).alias("position"), F.lit(c).alias("expected"))
            for i, (p, c) in enumerate(EXPECTED_COLORS)
        ]
    )
    wanted = found.select(key).distinct().select(key, F.inline(expected))
    rows = wanted.join(found, [key, "position"], "left").withColumn("color", F.coalesce("color", F.lit("VOID")))
    void = F.col("color") == "VOID"
    wrong = ~void & (F.col("color") != F.col("expected"))
    swap = F.concat(F.col("position"), F.lit(" is "), F.col("color"), F.lit(" (Expected "), F.col("expected"), F.lit(")"))

    def listed(when: Column, text: Column, sep: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(when, F.struct("at", text.alias("t")))))["t"], sep)

    out = rows.groupBy(key).agg(
        F.count_if(void).alias("missing_count"),
        listed(void, F.col("position"), ", ").alias("missing"),
        listed(wrong, swap, "; ").alias("swaps"),
    )
    return out.select(
        key,
        "missing_count",
        F.when(F.col("missing_count") >= 2, "missing_many")
        .when(F.col("missing_count") == 1, "missing_one")
        .when(F.col("swaps") != "", "swapped")
        .otherwise("normal")
        .alias("verdict"),
        F.when(F.col("missing_count") > 0, F.col("missing")).otherwise(F.col("swaps")).alias("details"),
    )


def part_ratio(parents: DataFrame, parts: DataFrame, key: str, *, short: float = 0.22, long: float = 0.45) -> DataFrame:
    """Length of the largest part over its parent's diameter.

    ``parents``: key, diameter, cx, cy, width, height. ``parts``: key, area, length, ordinal.
    """
    main = parts.groupBy(key).agg(
        F.min(F.struct((-F.col("area")).alias("a"), "ordinal", "length")).alias("_m")
    )
    ratio = F.col("_m.length") / F.col("diameter")
    row = F.when(F.col("cy") < F.col("height") / 2, "Top").otherwise("Bottom")
    column = F.when(F.col("cx") < F.col("width") / 2, "Left").otherwise("Right")
    return parents.join(main, key, "left").select(
        key,
        F.concat_ws("-", row, column).alias("position"),
        F.round(ratio, 6).alias("ratio"),
        F.when(ratio.isNull(), "missing").when(ratio < short, "short").when(ratio > long, "long").otherwise("normal").alias("status"),
    )


def completeness(
    parts: DataFrame, key: str, *, left: float, right: float, center: float, expected: int = 3, names=("Bulb 1", "Bulb 2")
) -> DataFrame:
    """Count, side and shape checks of repeated pins and named parts of one body.

    ``parts``: key, kind ("pin" or a name), ordinal, center_x, aspect, solidity, area. A side
    that cannot be seen is inferred from the opposite side of the other kind.
    """
    pin = F.col("kind") == "pin"
    named = parts.where(~pin).groupBy(key, "kind").agg(
        F.min(F.struct((-F.col("area")).alias("a"), "ordinal", "center_x", "aspect", "solidity")).alias("m")
    )
    x = F.col("m.center_x")
    off = F.when(x < center, x > left + 15).otherwise(x < right - 15)
    bent = off | (F.col("m.aspect") < 1.1) | (F.col("m.solidity") < 0.82)
    side = F.when(x < center, "Left").otherwise("Right")
    bulbs = named.groupBy(key).agg(
        F.avg(x).alias("bulb_x"),
        F.collect_set("kind").alias("seen"),
        F.array_join(F.array_sort(F.collect_list(F.when(bent, F.concat("kind", F.lit(" ("), side, F.lit(" Edge)"))))), "; ").alias("bent_named"),
    )
    pins = parts.groupBy(key).agg(F.avg(F.when(pin, F.col("center_x"))).alias("pin_x"), F.count_if(pin).alias("pins"))
    state = pins.join(bulbs, key, "left")
    edge = lambda c: F.when(F.col(c) > center, "Right Edge").when(F.col(c).isNotNull(), "Left Edge")
    state = state.withColumns({"_p": edge("pin_x"), "_b": edge("bulb_x")})
    flip = lambda c: F.when(F.col(c) == "Left Edge", "Right Edge").when(F.col(c) == "Right Edge", "Left Edge")
    state = state.withColumns(
        {
            "pin_side": F.coalesce("_p", flip("_b"), F.lit("Unknown")),
            "bulb_side": F.coalesce("_b", flip("_p"), F.lit("Unknown")),
        }
    )
    moved = F.when(F.col("pin_side") == "Left Edge", F.col("center_x") > left + 20).when(
        F.col("pin_side") == "Right Edge", F.col("center_x") < right - 20
    )
    crooked = F.coalesce(moved, F.lit(False)) | (F.col("aspect") < 2.0) | (F.col("solidity") < 0.75)
    bent_pins = parts.where(pin).join(state.select(key, "pin_side"), key).groupBy(key).agg(F.count_if(crooked).alias("bent_pins"))
    missing = F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("seen", F.array().cast("array<string>")))
    out = state.join(bent_pins, key, "left").select(
        key,
        "pins",
        F.greatest(F.lit(0), F.lit(expected) - F.col("pins")).alias("missing_pins"),
        "pin_side",
        "bulb_side",
        F.coalesce("bent_pins", F.lit(0)).alias("bent_pins"),
        F.array_join(missing, ", ").alias("missing_named"),
        F.coalesce("bent_named", F.lit("")).alias("bent_named"),
    )
    fine = (F.col("missing_pins") == 0) & (F.col("bent_pins") == 0) & (F.col("missing_named") == "") & (F.col("bent_named") == "")
    return out.withColumn("verdict", F.when(fine, "normal").otherwise("defect"))


def participation(rows: DataFrame) -> DataFrame:
    """Which streams took part, from a sample's counters.

    Search: search_steps, search_enabled, region_count, crop_count. Masks: text_hits,
    veto_status, refined_crops, mask_scores, refinement_enabled. Blocks: array of structs
    with graph_path, source_path and visual_backed.
    """
    blocks = F.col("blocks")

    def backed(test) -> Column:
        return F.size(F.filter(blocks, test))

    graph, text = backed(lambda b: F.coalesce(b["graph_path"], F.lit("")) != ""), backed(lambda b: F.coalesce(b["source_path"], F.lit("")) != "")
    return rows.select(
        *[c for c in rows.columns if c != "blocks"],
        F.when(F.col("search_steps") > 0, "searched")
        .when(~F.col("search_enabled"), "disabled_by_task_policy")
        .when(F.col("region_count") <= 0, "skipped_no_region_proposals")
        .when(F.col("crop_count") <= 0, "skipped_no_selected_crops")
        .otherwise("missing_action_trace")
        .alias("search_status"),
        F.when(F.col("text_hits") > 0, "text_prompt_refinement")
        .when(F.col("veto_status") == "attempted", "normal_part_veto")
        .when(F.col("refined_crops") > 0, "box_prompt_refinement")
        .when(F.col("mask_scores") > 0, "attempted_no_selected_mask")
        .when(~F.col("refinement_enabled"), "disabled_by_policy")
        .otherwise("not_attempted")
        .alias("mask_status"),
        F.size(blocks).alias("block_count"),
        graph.alias("graph_path_count"),
        text.alias("source_path_count"),
        backed(lambda b: b["visual_backed"]).alias("visual_backed_count"),
        ((F.size(blocks) > 0) & (graph == F.size(blocks)) & (text == F.size(blocks))).alias("all_blocks_backed"),
    )

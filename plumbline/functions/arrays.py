"""Column functions over arrays of pixel values (row-major) and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.numbers import clamp


def finite(values: Column) -> Column:
    return F.filter(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (v != F.lit(math.inf)) & (v != F.lit(-math.inf))
    )


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; inside array functions it would be re-evaluated per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def tail_mean(values: Column, fraction: float = 0.01) -> Column:
    """Mean of the highest ``ceil(n * fraction)`` finite values; 0 for none."""
    kept = finite(values)
    share = min(1.0, max(0.0001, float(fraction)))
    top = F.slice(F.sort_array(kept, asc=False), F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(kept) * share).cast("int")))
    return F.coalesce(mean(top), F.lit(0.0))


def sorted_quantile(ascending: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array sorted in ascending order."""
    at = (F.size(ascending) - 1) * F.lit(float(q))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.get(ascending, low) + (F.get(ascending, high) - F.get(ascending, low)) * (at - low)


def median(values: Column) -> Column:
    return let(F.sort_array(values), lambda ordered: sorted_quantile(ordered, 0.5))


def robust_centre(values: Column) -> tuple[Column, Column]:
    """Median and 1.4826 * MAD (at least 1e-6); 0 and 1 for an empty array."""
    centre = median(values)
    spread = let(centre, lambda c: median(F.transform(values, lambda v: F.abs(v - c))))
    return F.coalesce(centre, F.lit(0.0)), F.coalesce(F.greatest(F.lit(1e-6), spread * 1.4826), F.lit(1.0))


def tail_cutoff(values: Column, *, fraction: float = 0.05, min_score: float = 0.0, min_pixels: Column | int = 1) -> Column:
    """Value of the last pixel inside the top share of positive pixels; null when nothing exceeds ``min_score``."""
    kept = finite(values)
    positive = F.sort_array(F.filter(kept, lambda v: v > 0), asc=False)
    share = min(0.20, max(0.001, float(fraction)))
    least = F.lit(min_pixels) if isinstance(min_pixels, int) else min_pixels
    count = F.least(F.greatest(least, F.rint(F.size(positive) * share).cast("int")), F.size(positive))
    usable = (F.array_max(kept) > min_score) & (F.size(positive) > 0)
    return F.when(usable, F.greatest(F.lit(float(min_score)), F.get(positive, count - 1)))


def adaptive_cutoffs(values: Column, default_image: Column, default_pixel: Column, source: str = "adaptive") -> Column:
    """Image and pixel cutoffs from one map's own quantiles and peak, as a struct with the source label."""
    ordered = F.sort_array(finite(values))
    peak = F.get(ordered, F.size(ordered) - 1)
    pixel = F.greatest(F.lit(0.0), F.least(default_pixel, sorted_quantile(ordered, 0.985), peak * 0.85))
    image = F.greatest(pixel, F.least(default_image, sorted_quantile(ordered, 0.995), peak * 0.95))
    plain = peak.isNull() | (peak <= 0)
    return F.struct(
        F.when(plain, default_image).otherwise(image).alias("image"),
        F.when(plain, default_pixel).otherwise(pixel).alias("pixel"),
        F.when(peak.isNull(), f"{source}:empty").when(peak <= 0, f"{source}:zero").otherwise(source).alias("source"),
    )


def select_score(image_score: Column, tail_score: Column, policy: str = "auto") -> Column:
    """Score and its source label under a policy, as a struct."""
    usable = image_score.isNotNull() & ~F.isnan(image_score) & (F.abs(image_score) != math.inf)
    plans = {
        "auto": (F.when(usable, image_score).otherwise(tail_score), "localizer_image_score", "heatmap_tail_score"),
        "localizer_image": (
            F.when(usable, image_score).otherwise(tail_score),
            "localizer_image_score",
            "heatmap_tail_score_fallback",
        ),
        "heatmap_tail": (tail_score, "heatmap_tail_score", "heatmap_tail_score"),
        "max_image_heatmap": (
            F.when(usable, F.greatest(image_score, tail_score)).otherwise(tail_score),
            "max_image_heatmap",
            "max_image_heatmap",
        ),
        "mean_image_heatmap": (
            F.when(usable, (image_score + tail_score) / 2.0).otherwise(tail_score),
            "mean_image_heatmap",
            "heatmap_tail_score_fallback",
        ),
    }
    if policy not in plans:
        raise ValueError(f"unsupported score source: {policy}")
    score, label, fallback = plans[policy]
    return F.struct(score.alias("score"), F.when(usable, label).otherwise(fallback).alias("score_source"))


def fuse(maps: list[Column], kind: str = "harmonic_mean") -> Column:
    """Elementwise mean of aligned arrays."""
    if kind == "average_mean":
        part, whole = (lambda v: v), (lambda s: s / float(len(maps)))
    elif kind == "harmonic_mean":
        part, whole = (lambda v: F.try_divide(F.lit(1.0), v)), (lambda s: F.try_divide(F.lit(float(len(maps))), s))
    else:
        raise ValueError(kind)
    out = F.transform(maps[0], part)
    for other in maps[1:]:
        out = F.zip_with(out, other, lambda a, b: a + part(b))
    return F.transform(out, whole)


def harmonic(*values: Column) -> Column:
    inverse = sum((F.try_divide(F.lit(1.0), v) for v in values[1:]), F.try_divide(F.lit(1.0), values[0]))
    return F.try_divide(F.lit(float(len(values))), inverse)


def min_max(values: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Rescale to 0..1 by given or observed bounds; a zero range gives 0."""
    low = F.array_min(values) if low is None else low
    high = F.array_max(values) if high is None else high
    return let(
        F.struct(low.alias("low"), high.alias("high")),
        lambda b: F.transform(
            values, lambda v: F.coalesce(F.try_divide(v - b["low"], b["high"] - b["low"]), F.lit(0.0))
        ),
    )


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def lit_positions(mask: Column) -> Column:
    """Flat positions of true pixels."""
    return F.array_compact(F.transform(mask, lambda m, i: F.when(m, i)))


def mask_stats(mask: Column, width: Column, image_width: Column, image_height: Column) -> Column:
    """area_pixels, area_ratio and inclusive-extent box of a boolean mask; zeros and nulls when empty."""
    at = lit_positions(mask)
    xs, ys = F.transform(at, lambda p: p % width), F.transform(at, lambda p: F.floor(p / width).cast("int"))
    area = F.size(at)
    return F.struct(
        area.alias("area_pixels"),
        (area / F.greatest(F.lit(1), image_width * image_height)).alias("area_ratio"),
        F.array_min(xs).alias("x"),
        F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs) + 1).alias("w"),
        (F.array_max(ys) - F.array_min(ys) + 1).alias("h"),
    )


def mask_quality(stats: Column, width: Column, height: Column) -> Column:
    """Reject reasons of a mask from its stats: too small or large, near-whole box, hugging the border."""
    empty = stats["area_pixels"] <= 0
    x2, y2 = stats["x"] + stats["w"], stats["y"] + stats["h"]
    touches = (
        (stats["x"] <= 0).cast("int") + (stats["y"] <= 0).cast("int") + (x2 >= width).cast("int") + (y2 >= height).cast("int")
    )
    box_ratio = stats["w"] * stats["h"] / F.greatest(F.lit(1), width * height)
    ratio = stats["area_ratio"]
    reasons = F.array_compact(
        F.array(
            F.when(ratio < 0.0005, "mask_too_small"),
            F.when(ratio > 0.85, "mask_too_large"),
            F.when(box_ratio > 0.92, "bbox_near_whole_image"),
            F.when((touches >= 3) & (ratio > 0.25), "mask_hugs_image_boundary"),
        )
    )
    reasons = F.when(empty, F.array(F.lit("empty_mask"))).otherwise(reasons)
    return F.struct(
        (F.size(reasons) == 0).alias("accepted"),
        reasons.alias("reasons"),
        F.when(empty, 0.0).otherwise(F.round(box_ratio, 6)).alias("bbox_area_ratio"),
        F.when(empty, 0).otherwise(touches).alias("edge_touch_count"),
    )


def crop(values: Column, width: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixels of a box (inside the map), row by row; null for an empty box."""
    rows = F.transform(F.sequence(y1, y2 - 1), lambda y: F.slice(values, y * width + x1 + 1, x2 - x1))
    return F.when((x2 > x1) & (y2 > y1), F.flatten(rows))


def clip01(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)

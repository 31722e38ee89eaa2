"""Decision thresholds per category, learned from normal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import general_format
from plumbline.operators.ranks import order_statistics

MAD_TO_SIGMA = 1.4826
SMALL_SAMPLE = 5
DEFAULT_THRESHOLD = 0.5
KEYS = ["dataset", "category"]


def calibration_rows(train: DataFrame, shots: int = -1, keys=KEYS, order: str = "image_path") -> DataFrame:
    """All rows (shots < 0), none (0) or the first ``shots`` rows of each category."""
    if shots < 0:
        return train
    if shots == 0:
        return train.limit(0)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return train.withColumn("_place", place).where(F.col("_place") <= shots).drop("_place")


def robust_stats(rows: DataFrame, *, quantile: float = 0.995, keys=KEYS, score: str = "score") -> DataFrame:
    """``keys, n, median, mad, quantile, max_score`` - exact, with no group gathered in one task."""
    stats = order_statistics(rows, keys, score, {"median": 0.5, "quantile": quantile}, deviation="mad")
    return stats.select(*keys, "n", "median", "mad", "quantile", F.col("max_value").alias("max_score"))


def _threshold(policy: str, quantile: float, mad_scale: float) -> tuple[Column, str]:
    robust = F.col("median") + F.lit(mad_scale * MAD_TO_SIGMA) * F.col("mad")
    robust_text = f"median+{mad_scale:g}*1.4826*MAD"
    if policy == "normal_quantile":
        return F.col("quantile"), f"q{quantile:g}"
    if policy == "normal_median_mad":
        return robust, robust_text
    if policy == "normal_robust":
        return F.greatest(F.col("quantile"), robust), f"max(q{quantile:g}, {robust_text})"
    raise ValueError(f"unsupported threshold policy: {policy}")


def calibrate(
    train: DataFrame,
    *,
    policy: str = "normal_robust",
    quantile: float = 0.995,
    mad_scale: float = 6.0,
    shots: int = -1,
    keys=KEYS,
) -> DataFrame:
    """One row per category: threshold, its policy text and the statistics behind it."""
    threshold, text = _threshold(policy, quantile, mad_scale)
    small = F.col("n") < SMALL_SAMPLE
    return robust_stats(calibration_rows(train, shots, keys), quantile=quantile, keys=keys).select(
        *keys,
        "n",
        "median",
        "mad",
        "quantile",
        "max_score",
        F.when(small, F.greatest(threshold, F.col("max_score"))).otherwise(threshold).alias("threshold"),
        F.when(small, text + "; small_n_floor=max_train_score").otherwise(text).alias("threshold_policy"),
        F.lit(shots).alias("calibration_shots"),
    )


def preset_thresholds(
    categories: DataFrame,
    train: DataFrame,
    *,
    fixed: float | None = None,
    table: DataFrame | None = None,
    quantile: float = 0.995,
    keys=KEYS,
    source: str = "binary_ad_threshold_table",
) -> DataFrame:
    """Thresholds given in advance (one value, or a table), with descriptive statistics.

    Categories without scores get zero statistics; without a threshold they get 0.5.
    """
    stats = robust_stats(train, quantile=quantile, keys=keys)
    rows = categories.join(stats, keys, "left")
    if table is None:
        value = F.lit(DEFAULT_THRESHOLD if fixed is None else float(fixed))
        text = F.concat(F.lit("fixed("), general_format(value), F.lit(")"))
    else:
        rows = rows.join(table.select(*keys, F.col("threshold").alias("_t"), F.col("source").alias("_s")), keys, "left")
        value = F.coalesce(F.col("_t"), F.lit(DEFAULT_THRESHOLD))
        label = F.coalesce(F.nullif(F.col("_s"), F.lit("")), F.lit(source))
        text = F.concat(F.lit("table("), label, F.lit(":"), general_format(value), F.lit(")"))
    return rows.select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median", "mad", "quantile", "max_score")],
        value.alias("threshold"),
        text.alias("threshold_policy"),
    )


def lookup_thresholds(
    requests: DataFrame, rows: DataFrame, *, default_source: str = "threshold_table"
) -> DataFrame:
    """Best threshold row per request.

    ``requests``: request_id, dataset, category, localizer, shot (null = any).
    ``rows``: ordinal, dataset, category, localizer, shot, threshold, source; an empty
    localizer or null shot matches anything. The first row that matches exactly wins;
    with none, the last compatible row does.
    """
    req, row = requests.alias("q"), rows.alias("r")
    row_loc = F.lower(F.coalesce(F.col("r.localizer"), F.lit("")))
    req_loc = F.lower(F.coalesce(F.col("q.localizer"), F.lit("")))
    shot_fits = F.col("r.shot").isNull() | F.col("q.shot").isNull() | (F.col("r.shot") == F.col("q.shot"))
    fits = ((row_loc == "") | (req_loc == "") | (row_loc == req_loc)) & shot_fits
    exact = row_loc == req_loc
    joined = req.join(
        row,
        (F.lower(F.col("r.dataset")) == F.lower(F.col("q.dataset"))) & (F.col("r.category") == F.col("q.category")),
    ).where(fits)
    first_exact = F.min(F.when(exact, F.struct(F.col("r.ordinal"), F.col("r.threshold"), F.col("r.source"))))
    last_any = F.max(F.struct(F.col("r.ordinal"), F.col("r.threshold"), F.col("r.source")))
    best = joined.groupBy("q.request_id").agg(F.coalesce(first_exact, last_any).alias("_b"))
    return requests.join(best, "request_id", "left").select(
        "request_id",
        F.col("_b.threshold").alias("threshold"),
        F.when(
            F.col("_b.threshold").isNotNull(), F.coalesce(F.nullif(F.col("_b.source"), F.lit("")), F.lit(default_source))
        )
        .otherwise("")
        .alias("threshold_source"),
    )


def resolve_map_thresholds(
    images: DataFrame, table: DataFrame, *, default_image: float = 0.9, default_pixel: float = 0.9
) -> DataFrame:
    """Heatmap thresholds per image: the category's table row, else adaptive, else defaults.

    ``images``: image_id, category, adaptive_image, adaptive_pixel (null when there is no map).
    ``table``: category, image_threshold, pixel_threshold (either may be null).
    """
    listed = F.col("image_threshold").isNotNull() | F.col("pixel_threshold").isNotNull()
    mapped = F.col("adaptive_image").isNotNull()
    return images.join(table, "category", "left").select(
        "image_id",
        "category",
        F.when(listed, F.coalesce("image_threshold", F.lit(default_image)))
        .when(mapped, F.col("adaptive_image"))
        .otherwise(F.lit(default_image))
        .alias("image_cutoff"),
        F.when(listed, F.coalesce("pixel_threshold", F.lit(default_pixel)))
        .when(mapped, F.col("adaptive_pixel"))
        .otherwise(F.lit(default_pixel))
        .alias("pixel_cutoff"),
        F.when(listed, "decision_parameters")
        .when(mapped, "adaptive_unknown_category")
        .otherwise("default_unknown_category")
        .alias("cutoff_source"),
    )

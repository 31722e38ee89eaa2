"""Heatmaps and masks as arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions import geometry as G
from plumbline.operators import calibrate as cal
from plumbline.operators import regions as R
from plumbline.plans.fixtures import HEATMAPS_SQL, PIXELS_SQL, heatmaps
from plumbline.plans.registry import query

H = "WITH " + HEATMAPS_SQL


@query(
    "sco1_tail_mean",
    H
    + """ SELECT image_id, round(list_avg(list_reverse_sort(vals)[:greatest(1, CAST(ceil(64 * 0.01::DOUBLE) AS INTEGER))]), 6) AS tail_1pct,
      round(list_avg(list_reverse_sort(vals)[:CAST(ceil(64 * 0.25::DOUBLE) AS INTEGER)]), 6) AS tail_25pct, round(list_avg(vals), 6) AS whole FROM heatmaps""",
)
def tail_mean(spark, folder):
    out = {"tail_1pct": 0.01, "tail_25pct": 0.25, "whole": 1.0}
    return heatmaps(spark, folder).select(
        "image_id", *[F.round(A.tail_mean(F.col("vals"), f), 6).alias(n) for n, f in out.items()]
    )


@query(
    "sco2_score_source",
    H
    + """, s AS (SELECT image_id, list_reverse_sort(vals)[1] AS tail, CASE image_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE ELSE vals[1] END AS img FROM heatmaps),
    u AS (SELECT *, img IS NOT NULL AND NOT isnan(img) AS ok FROM s)
    SELECT image_id, round(CASE WHEN ok THEN img ELSE tail END, 6) AS auto_score, CASE WHEN ok THEN 'localizer_image_score' ELSE 'heatmap_tail_score' END AS auto_source,
      CASE WHEN ok THEN 'localizer_image_score' ELSE 'heatmap_tail_score_fallback' END AS image_source, round(CASE WHEN ok THEN greatest(img, tail) ELSE tail END, 6) AS max_score,
      round(CASE WHEN ok THEN (img + tail) / 2 ELSE tail END, 6) AS mean_score, CASE WHEN ok THEN 'mean_image_heatmap' ELSE 'heatmap_tail_score_fallback' END AS mean_source FROM u""",
)
def score_source(spark, folder):
    kind = F.col("image_id") % 4
    image = F.when(kind == 1, float("nan")).when(kind > 1, F.get("vals", F.lit(0)))
    rows = heatmaps(spark, folder).select("image_id", image.alias("img"), A.tail_mean(F.col("vals")).alias("tail"))

    def pick(policy):
        return A.select_score(F.col("img"), F.col("tail"), policy)

    return rows.select(
        "image_id",
        F.round(pick("auto")["score"], 6).alias("auto_score"),
        pick("auto")["score_source"].alias("auto_source"),
        pick("localizer_image")["score_source"].alias("image_source"),
        F.round(pick("max_image_heatmap")["score"], 6).alias("max_score"),
        F.round(pick("mean_image_heatmap")["score"], 6).alias("mean_score"),
        pick("mean_image_heatmap")["score_source"].alias("mean_source"),
    )


@query(
    "sco3_fused_maps",
    H
    + """, m AS (SELECT image_id, vals AS a, list_transform(vals, lambda v: v + 0.1::DOUBLE) AS b, list_reverse(vals) AS c FROM heatmaps)
    SELECT image_id, round(list_sum(list_transform(range(1, 65), lambda i: (a[i] + b[i] + c[i]) / 3)), 6) AS mean_total,
      round(list_sum(list_transform(range(1, 65), lambda i: 3 / (1 / (a[i] + 0.01::DOUBLE) + 1 / b[i] + 1 / (c[i] + 0.01::DOUBLE)))), 6) AS harmonic_total FROM m""",
)
def fused_maps(spark, folder):
    shifted = F.transform("vals", lambda v: v + 0.1)
    plus = F.transform("vals", lambda v: v + 0.01)
    return heatmaps(spark, folder).select(
        "image_id",
        F.round(A.total(A.fuse([F.col("vals"), shifted, F.reverse("vals")], "average_mean")), 6).alias("mean_total"),
        F.round(A.total(A.fuse([plus, shifted, F.reverse(plus)])), 6).alias("harmonic_total"),
    )


@query(
    "sco4_composed_scores",
    H
    + """ SELECT image_id, round((vals[1] + vals[2] + list_max(vals)) / 3, 6) AS zero_shot,
      round(2 / (1 / ((vals[1] + vals[2] + vals[3]) / 3) + 1 / list_max(vals)), 6) AS few_shot FROM heatmaps""",
)
def composed_scores(spark, folder):
    a, b, c = (F.get("vals", F.lit(i)) for i in range(3))
    peak = F.array_max("vals")
    return heatmaps(spark, folder).select(
        "image_id",
        F.round((a + b + peak) / 3.0, 6).alias("zero_shot"),
        F.round(A.harmonic((a + b + c) / 3.0, peak), 6).alias("few_shot"),
    )


@query(
    "sco5_min_max",
    H
    + """ SELECT image_id, round(list_sum(list_transform(vals, lambda v: (v - list_min(vals)) / (list_max(vals) - list_min(vals)))), 6) AS observed,
      round(list_sum(list_transform(vals, lambda v: (v - 0.05::DOUBLE) / 0.45::DOUBLE)), 6) AS given FROM heatmaps""",
)
def min_max(spark, folder):
    return heatmaps(spark, folder).select(
        "image_id",
        F.round(A.total(A.min_max(F.col("vals"))), 6).alias("observed"),
        F.round(A.total(A.min_max(F.col("vals"), F.lit(0.05), F.lit(0.5))), 6).alias("given"),
    )


@query(
    "sco15_mask_intersection",
    H + " SELECT image_id, len(list_filter(range(1, 65), lambda i: mask[i] AND vals[i] > 0.1::DOUBLE)) AS hot_pixels FROM heatmaps",
)
def mask_intersection(spark, folder):
    both = F.zip_with("mask", "vals", lambda m, v: m & (v > 0.1))
    return heatmaps(spark, folder).select("image_id", F.size(A.lit_positions(both)).cast("long").alias("hot_pixels"))


SALIENT = H + """, t AS (SELECT *, list_reverse_sort(list_filter(vals, lambda v: v > 0)) AS pos FROM heatmaps),
 c AS (SELECT *, pos[least(len(pos), greatest(1, CAST(round_even(len(pos) * 0.05::DOUBLE, 0) AS INTEGER)))] AS cutoff FROM t),
 s AS (SELECT *, list_filter(range(0, 64), lambda i: vals[i + 1] >= cutoff) AS hits FROM c)"""


@query(
    "sco16_salient_mask",
    SALIENT + " SELECT image_id, round(cutoff, 6) AS cutoff, len(hits) AS salient_pixels, array_to_string(hits, ',') AS positions FROM s",
)
def salient_mask(spark, folder):
    rows = heatmaps(spark, folder).withColumn("cut", A.tail_cutoff(F.col("vals")))
    hits = A.lit_positions(F.transform("vals", lambda v: v >= F.col("cut")))
    return rows.select(
        "image_id",
        F.round("cut", 6).alias("cutoff"),
        F.size(hits).cast("long").alias("salient_pixels"),
        F.array_join(F.transform(hits, lambda i: i.cast("string")), ",").alias("positions"),
    )


@query(
    "sco17_salient_centroid",
    SALIENT
    + """, m AS (SELECT image_id, list_avg(list_transform(hits, lambda i: i % 8)) / 7 AS cx, list_avg(list_transform(hits, lambda i: i // 8)) / 7 AS cy FROM s)
    SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, CASE WHEN cx < 0.42::DOUBLE THEN 'left' WHEN cx > 0.58::DOUBLE THEN 'right' ELSE 'both' END AS side_x,
      CASE WHEN cy < 0.42::DOUBLE THEN 'up' WHEN cy > 0.58::DOUBLE THEN 'down' ELSE 'both' END AS side_y FROM m""",
)
def salient_centroid(spark, folder):
    least = F.greatest(F.lit(1), F.floor(F.size("vals") * 0.01).cast("int"))
    rows = heatmaps(spark, folder).withColumn("cutoff", A.tail_cutoff(F.col("vals"), min_pixels=least))
    rows = rows.withColumn("hits", A.lit_positions(F.transform("vals", lambda v: v >= F.col("cutoff"))))
    xs = F.transform("hits", lambda p: (p % F.col("width")).cast("double"))
    ys = F.transform("hits", lambda p: F.floor(p / F.col("width")).cast("double"))
    rows = rows.select(
        "image_id",
        (A.mean(xs) / F.greatest(F.lit(1), F.col("width") - 1)).alias("cx"),
        (A.mean(ys) / F.greatest(F.lit(1), F.col("height") - 1)).alias("cy"),
    )

    def side(c, low, high):
        return F.when(F.col(c) < 0.42, low).when(F.col(c) > 0.58, high).otherwise("both")

    return rows.select(
        "image_id",
        F.round("cx", 6).alias("cx"),
        F.round("cy", 6).alias("cy"),
        side("cx", "left", "right").alias("side_x"),
        side("cy", "up", "down").alias("side_y"),
    )


CUTOFFS = H + """, q AS (SELECT image_id, category, list_max(vals) AS peak, list_aggregate(vals, 'quantile_cont', 0.985) AS q1, list_aggregate(vals, 'quantile_cont', 0.995) AS q2 FROM heatmaps),
 p AS (SELECT *, greatest(0, least(0.45::DOUBLE, q1, peak * 0.85::DOUBLE)) AS pix FROM q),
 adaptive AS (SELECT *, greatest(pix, least(0.5::DOUBLE, q2, peak * 0.95::DOUBLE)) AS img FROM p)"""


@query("cal7_adaptive_cutoffs", CUTOFFS + " SELECT image_id, round(img, 6) AS image_cutoff, round(pix, 6) AS pixel_cutoff, 'adaptive' AS source FROM adaptive")
def adaptive_cutoffs(spark, folder):
    got = A.adaptive_cutoffs(F.col("vals"), F.lit(0.5), F.lit(0.45))
    rows = heatmaps(spark, folder).select("image_id", got.alias("c"))
    return rows.select("image_id", F.round("c.image", 6).alias("image_cutoff"), F.round("c.pixel", 6).alias("pixel_cutoff"), "c.source")


@query(
    "cal8_resolved_cutoffs",
    CUTOFFS
    + """, t AS (SELECT * FROM (VALUES ('cat1', 0.3::DOUBLE, 0.2::DOUBLE), ('cat2', 0.35::DOUBLE, NULL), ('cat3', NULL, 0.15::DOUBLE)) v(category, it, pt)),
    j AS (SELECT a.*, it, pt, it IS NOT NULL OR pt IS NOT NULL AS listed, image_id % 5 <> 0 AS mapped FROM adaptive a LEFT JOIN t USING (category))
    SELECT image_id, category, round(CASE WHEN listed THEN coalesce(it, 0.9::DOUBLE) WHEN mapped THEN img ELSE 0.9::DOUBLE END, 6) AS image_cutoff,
      round(CASE WHEN listed THEN coalesce(pt, 0.9::DOUBLE) WHEN mapped THEN pix ELSE 0.9::DOUBLE END, 6) AS pixel_cutoff,
      CASE WHEN listed THEN 'decision_parameters' WHEN mapped THEN 'adaptive_unknown_category' ELSE 'default_unknown_category' END AS cutoff_source FROM j""",
)
def resolved_cutoffs(spark, folder):
    got = A.adaptive_cutoffs(F.col("vals"), F.lit(0.5), F.lit(0.45))
    rows = heatmaps(spark, folder).select("image_id", "category", F.when(F.col("image_id") % 5 != 0, got).alias("c"))
    rows = rows.select("image_id", "category", F.col("c.image").alias("adaptive_image"), F.col("c.pixel").alias("adaptive_pixel"))
    given = spark.createDataFrame(
        [("cat1", 0.3, 0.2), ("cat2", 0.35, None), ("cat3", None, 0.15)],
        "category string, image_threshold double, pixel_threshold double",
    )
    out = cal.resolve_map_thresholds(rows, F.broadcast(given))
    return out.withColumns({c: F.round(c, 6) for c in ("image_cutoff", "pixel_cutoff")})


MASK = H + """, a AS (SELECT image_id, list_filter(range(0, 64), lambda i: mask[i + 1] AND (image_id % 9 <> 0) AND (image_id % 2 = 0 OR i // 8 > 2)) AS pts FROM heatmaps),
 b AS (SELECT image_id, len(pts) AS area, list_min(list_transform(pts, lambda p: p % 8)) AS x, list_min(list_transform(pts, lambda p: p // 8)) AS y,
   list_max(list_transform(pts, lambda p: p % 8)) AS xe, list_max(list_transform(pts, lambda p: p // 8)) AS ye FROM a)"""


def _masks(spark, folder):
    rows = heatmaps(spark, folder)
    keep = lambda m, i: m & (F.col("image_id") % 9 != 0) & ((F.col("image_id") % 2 == 0) | (F.floor(i / 8) > 2))
    return rows.withColumn("mask", F.transform("mask", keep))


@query(
    "agg16_mask_stats",
    MASK + " SELECT image_id, area AS area_pixels, round(area / 64, 6) AS area_ratio, x, y, xe - x + 1 AS w, ye - y + 1 AS h FROM b",
)
def mask_stats(spark, folder):
    stats = A.mask_stats(F.col("mask"), F.col("width"), F.lit(8), F.lit(8))
    out = _masks(spark, folder).select("image_id", stats.alias("s"))
    return out.select(
        "image_id",
        F.col("s.area_pixels").cast("long").alias("area_pixels"),
        F.round("s.area_ratio", 6).alias("area_ratio"),
        *[F.col(f"s.{c}").cast("long").alias(c) for c in "xywh"],
    )


@query(
    "agg17_mask_quality",
    MASK
    + """, e AS (SELECT *, area / 64 AS ratio, (xe - x + 1) * (ye - y + 1) / 64 AS box, CAST(x <= 0 AS INTEGER) + CAST(y <= 0 AS INTEGER) + CAST(xe >= 7 AS INTEGER) + CAST(ye >= 7 AS INTEGER) AS t FROM b)
    SELECT image_id, CASE WHEN area = 0 THEN 'empty_mask' ELSE array_to_string(list_filter([CASE WHEN ratio < 0.0005::DOUBLE THEN 'mask_too_small' END, CASE WHEN ratio > 0.85::DOUBLE THEN 'mask_too_large' END,
      CASE WHEN box > 0.92::DOUBLE THEN 'bbox_near_whole_image' END, CASE WHEN t >= 3 AND ratio > 0.25 THEN 'mask_hugs_image_boundary' END], lambda r: r IS NOT NULL), ';') END AS reasons,
      round(CASE WHEN area = 0 THEN 0 ELSE box END, 6) AS bbox_area_ratio, CASE WHEN area = 0 THEN 0 ELSE t END AS edge_touch_count FROM e""",
)
def mask_quality(spark, folder):
    stats = A.mask_stats(F.col("mask"), F.col("width"), F.lit(8), F.lit(8))
    rows = _masks(spark, folder).select("image_id", stats.alias("s"))
    out = rows.select("image_id", A.mask_quality(F.col("s"), F.lit(8), F.lit(8)).alias("q"))
    return out.select("image_id", F.array_join("q.reasons", ";").alias("reasons"), "q.bbox_area_ratio", "q.edge_touch_count")


# --- boxes over maps: up to three windows per image ------------------------------------

WINDOWS_SQL = HEATMAPS_SQL + """, windows AS (
  SELECT image_id, vals, mask, k, CAST((image_id + k) % 5 AS INTEGER) AS x1, CAST((image_id * 3 + k) % 4 AS INTEGER) AS y1,
    CAST((image_id + k) % 5 + 2 + image_id % 2 AS INTEGER) AS x2, CAST((image_id * 3 + k) % 4 + 3 AS INTEGER) AS y2 FROM heatmaps, (SELECT unnest(range(3)) AS k)),
rois AS (SELECT *, list_transform(list_filter(range(0, 64), lambda p: p % 8 >= x1 AND p % 8 < x2 AND p // 8 >= y1 AND p // 8 < y2), lambda p: vals[p + 1]) AS roi FROM windows)"""


def windows(spark, folder):
    image, k = F.col("image_id"), F.col("k")
    rows = heatmaps(spark, folder).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.withColumns({"x1": ((image + k) % 5).cast("int"), "y1": ((image * 3 + k) % 4).cast("int")})
    rows = rows.withColumns({"x2": (F.col("x1") + 2 + image % 2).cast("int"), "y2": F.col("y1") + 3})
    return rows.withColumn("roi", A.crop(*[F.col(c) for c in ("vals", "width", "x1", "y1", "x2", "y2")]))


@query(
    "agg18_box_features",
    "WITH "
    + WINDOWS_SQL
    + """, m AS (SELECT image_id, vals, median_ AS med, list_aggregate(list_transform(vals, lambda v: abs(v - median_)), 'median') AS mad, cutoff FROM (
       SELECT image_id, vals, list_aggregate(vals, 'median') AS median_, list_reverse_sort(vals)[GREATEST(1, CAST(round_even(64 * 0.1::DOUBLE, 0) AS INTEGER))] AS cutoff FROM heatmaps)),
    f AS (SELECT r.image_id, k, roi, (x2 - x1) * (y2 - y1) AS area, med, mad, list_filter(roi, lambda v: v >= cutoff) AS tail FROM rois r JOIN m USING (image_id))
    SELECT image_id, CAST(k AS INTEGER) AS k, round(list_max(roi), 6) AS peak, round(list_avg(tail), 6) AS tail_mean, round(least(1, len(tail) / area * 8), 6) AS coverage,
      round(least(1, len(tail) / 64 * 200), 6) AS compactness, round(greatest(0, (list_max(roi) - med) / greatest(1e-6, 1.4826 * mad)), 6) AS robust_peak_z FROM f""",
)
def box_features(spark, folder):
    centre, scale = A.robust_centre(A.finite(F.col("vals")))
    rows = windows(spark, folder).withColumns(
        {"cutoff": A.tail_cutoff(F.col("vals"), fraction=0.1), "centre": centre, "scale": scale}
    )
    rows = rows.withColumn("tail", F.filter("roi", lambda v: v >= F.col("cutoff")))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    peak = F.array_max("roi")
    return rows.select(
        "image_id",
        "k",
        F.round(peak, 6).alias("peak"),
        F.round(A.mean(F.col("tail")), 6).alias("tail_mean"),
        F.round(F.least(F.lit(1.0), F.size("tail") / area * 8.0), 6).alias("coverage"),
        F.round(F.least(F.lit(1.0), F.size("tail") / F.size("vals") * 200.0), 6).alias("compactness"),
        F.round(F.greatest(F.lit(0.0), (peak - F.col("centre")) / F.col("scale")), 6).alias("robust_peak_z"),
    )


@query(
    "geo5_window_scores",
    "WITH "
    + WINDOWS_SQL
    + """, c AS (SELECT *, list_reverse_sort(list_filter(roi, lambda v: v > 0)) AS pos FROM rois),
    d AS (SELECT *, list_filter(roi, lambda v: v >= pos[least(len(pos), greatest(1, CAST(round_even(len(pos) * 0.05::DOUBLE, 0) AS INTEGER)))]) AS sal FROM c),
    a AS (SELECT w.image_id, w.k, max(greatest(0, least(w.x2, p.x2) - greatest(w.x1, p.x1)) * greatest(0, least(w.y2, p.y2) - greatest(w.y1, p.y1)) /
       ((w.x2 - w.x1) * (w.y2 - w.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - greatest(0, least(w.x2, p.x2) - greatest(w.x1, p.x1)) * greatest(0, least(w.y2, p.y2) - greatest(w.y1, p.y1)))) AS best
       FROM windows w JOIN windows p ON p.image_id = w.image_id AND p.k <> w.k GROUP BY ALL)
    SELECT image_id, CAST(k AS INTEGER) AS k, round(list_avg(sal), 6) AS focus_mean, round(best, 6) AS alignment,
      round(0.6::DOUBLE * list_max(roi) + 0.25::DOUBLE * list_avg(sal) + 0.1::DOUBLE * least(1, len(sal) / len(roi) * 8) + 0.05::DOUBLE * best, 6) AS score
    FROM d JOIN a USING (image_id, k)""",
)
def window_scores(spark, folder):
    """Window score from peak, focus mean, coverage and overlap with the image's other windows (at most two)."""
    rows = windows(spark, folder)
    box = F.struct("k", "x1", "y1", "x2", "y2")
    others = rows.groupBy("image_id").agg(F.collect_list(box).alias("proposals"))
    least = F.greatest(F.lit(1), F.floor(F.size("roi") * 0.01).cast("int"))
    rows = rows.join(others, "image_id").withColumn("cutoff", A.tail_cutoff(F.col("roi"), min_pixels=least))
    rows = rows.withColumn("salient", F.filter("roi", lambda v: v >= F.col("cutoff")))
    own = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    overlaps = F.transform(
        F.filter("proposals", lambda p: p["k"] != F.col("k")), lambda p: G.iou(own, G.corners(p))
    )
    align = F.coalesce(F.array_max(overlaps), F.lit(0.0))
    focus = A.mean(F.col("salient"))
    coverage = F.least(F.lit(1.0), F.size("salient") / F.size("roi") * 8.0)
    score = F.array_max("roi") * 0.60 + focus * 0.25 + coverage * 0.10 + align * 0.05
    return rows.select(
        "image_id", "k", F.round(focus, 6).alias("focus_mean"), F.round(align, 6).alias("alignment"), F.round(score, 6).alias("score")
    )


@query(
    "jn7_mask_roi_match",
    "WITH "
    + WINDOWS_SQL
    + """, p AS (SELECT *, greatest(0, x1 - 1) AS a, greatest(0, y1 - 1) AS b, least(8, x2 + 1) AS c, least(8, y2 + 1) AS d FROM windows),
    o AS (SELECT image_id, k, len(list_filter(range(0, 64), lambda q: mask[q + 1] AND q % 8 >= a AND q % 8 < c AND q // 8 >= b AND q // 8 < d)) AS n, (c - a) * (d - b) AS area FROM p),
    s AS (SELECT *, n + n / area * 1000 + (image_id % 3) * 100 AS rank_score FROM o WHERE n > 0)
    SELECT image_id, CAST(k AS INTEGER) AS proposal, n AS mask_pixels, round(rank_score, 6) AS rank_score FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rank_score DESC, k) AS rn FROM s) WHERE rn = 1""",
)
def mask_roi_match(spark, folder):
    """Best padded region for an image's mask, by shared pixels, share of the region and prompt relevance."""
    rows = windows(spark, folder)
    padded = [
        F.greatest(F.lit(0), F.col("x1") - 1),
        F.greatest(F.lit(0), F.col("y1") - 1),
        F.least(F.col("width"), F.col("x2") + 1),
        F.least(F.col("height"), F.col("y2") + 1),
    ]
    inside = F.size(F.filter(A.crop(F.col("mask"), F.col("width"), *padded), lambda m: m))
    area = (padded[2] - padded[0]) * (padded[3] - padded[1])
    rows = rows.select("image_id", "k", inside.cast("long").alias("n"), area.alias("area")).where("n > 0")
    score = F.col("n") + F.col("n") / F.col("area") * 1000.0 + (F.col("image_id") % 3) * 100.0
    best = F.min(F.struct((-score).alias("s"), F.col("k"), F.col("n")))
    out = rows.groupBy("image_id").agg(best.alias("b"))
    return out.select(
        "image_id", F.col("b.k").alias("proposal"), F.col("b.n").alias("mask_pixels"), F.round(-F.col("b.s"), 6).alias("rank_score")
    )


# --- components ------------------------------------------------------------------------

COMPONENT_SQL = PIXELS_SQL + """, hot AS (SELECT image_id, category, pos, x, y, v FROM pixels WHERE v > 0.12::DOUBLE),
 reach AS (SELECT image_id, pos AS root, pos FROM hot
   UNION SELECT r.image_id, r.root, b.pos FROM reach r JOIN hot a ON a.image_id = r.image_id AND a.pos = r.pos
     JOIN hot b ON b.image_id = a.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
 owner AS (SELECT image_id, pos, min(root) AS root FROM reach GROUP BY ALL),
 comp AS (SELECT o.image_id, h.category, o.pos, h.x, h.y, h.v, dense_rank() OVER (PARTITION BY o.image_id ORDER BY root) AS component
   FROM owner o JOIN hot h ON h.image_id = o.image_id AND h.pos = o.pos)"""


def _labelled_pixels(spark, folder):
    maps = heatmaps(spark, folder).withColumn("mask", F.transform("vals", lambda v: v > 0.12))
    labels = R.component_labels(maps)
    rows = maps.join(labels, "image_id").select("image_id", F.posexplode(F.arrays_zip("vals", "labels")).alias("pos", "p"))
    return rows.select(
        "image_id", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.col("p.vals").alias("v"), F.col("p.labels").alias("component")
    ).where("component > 0")


@query(
    "reg2_components",
    "WITH RECURSIVE "
    + COMPONENT_SQL
    + " SELECT image_id, CAST(component AS INTEGER) AS component, count(*) AS area, round(max(v), 6) AS peak, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y FROM comp GROUP BY ALL",
)
def components(spark, folder):
    return _labelled_pixels(spark, folder).groupBy("image_id", "component").agg(
        F.count(F.lit(1)).alias("area"), F.round(F.max("v"), 6).alias("peak"), F.min("x").alias("x"), F.min("y").alias("y")
    )


@query(
    "reg5_best_component",
    "WITH RECURSIVE "
    + COMPONENT_SQL
    + """, peaks AS (SELECT image_id, component, max(v) AS peak FROM comp GROUP BY ALL),
    inside AS (SELECT DISTINCT image_id, component FROM comp WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 5)
    SELECT image_id, CAST(arg_max(component, peak) AS INTEGER) AS best_component FROM inside JOIN peaks USING (image_id, component) GROUP BY image_id""",
)
def best_component(spark, folder):
    pixels = _labelled_pixels(spark, folder)
    inside = F.col("x").between(2, 6) & F.col("y").between(1, 5)
    per = pixels.groupBy("image_id", "component").agg(F.max("v").alias("peak"), F.bool_or(inside).alias("inside"))
    return per.where("inside").groupBy("image_id").agg(F.max_by("component", "peak").alias("best_component"))


@query(
    "reg7_merged_masks",
    "WITH "
    + PIXELS_SQL
    + """, m AS (SELECT image_id // 4 AS group_id, image_id, max(v) FILTER (pos = 0) AS score FROM pixels GROUP BY ALL),
    best AS (SELECT group_id, max(score) AS top, arg_max(image_id, score) AS best_id FROM m GROUP BY ALL),
    chosen AS (SELECT m.group_id, image_id, score FROM m JOIN best USING (group_id) WHERE score > 0.15::DOUBLE OR (top <= 0.15::DOUBLE AND image_id = best_id)),
    merged AS (SELECT group_id, pos, bool_or(on_mask) AS lit FROM chosen JOIN pixels USING (image_id) GROUP BY ALL)
    SELECT g.group_id, count(*) FILTER (lit) AS merged_pixels, round(any_value(s), 6) AS score FROM merged g JOIN (SELECT group_id, max(score) AS s FROM chosen GROUP BY ALL) USING (group_id) GROUP BY g.group_id""",
)
def merged_masks(spark, folder):
    rows = heatmaps(spark, folder).select(
        F.floor(F.col("image_id") / 4).alias("group_id"), "image_id", F.get("vals", F.lit(0)).alias("score"), "mask"
    )
    merged = merge_masks(rows, "group_id", 0.15)
    return merged.select("group_id", F.size(A.lit_positions(F.col("mask"))).cast("long").alias("merged_pixels"), F.round("score", 6).alias("score"))


def merge_masks(rows, key: str, threshold: float):
    """Union of a group's masks scoring above the threshold, or its best mask when none does.

    Masks of one size are combined pixel by pixel, so a large group is merged by partial aggregates.
    """
    best = rows.groupBy(key).agg(F.max("score").alias("_top"), F.max_by("image_id", "score").alias("_best"))
    rows = rows.join(best, key)
    chosen = rows.where((F.col("score") > threshold) | ((F.col("_top") <= threshold) & (F.col("image_id") == F.col("_best"))))
    pixels = chosen.select(key, "score", F.posexplode("mask").alias("pos", "lit"))
    per_pixel = pixels.groupBy(key, "pos").agg(F.bool_or("lit").alias("lit"), F.max("score").alias("score"))
    return per_pixel.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "lit")))["lit"].alias("mask"), F.max("score").alias("score")
    )


@query(
    "agg11_region_overlap_area",
    "WITH RECURSIVE "
    + PIXELS_SQL
    + """, lit AS (SELECT image_id, pos, x, y FROM pixels WHERE on_mask),
    near AS (SELECT a.image_id, a.pos, b.pos AS other FROM lit a JOIN lit b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    reach AS (SELECT image_id, pos AS root, pos FROM lit UNION SELECT r.image_id, r.root, n.other FROM reach r JOIN near n ON n.image_id = r.image_id AND n.pos = r.pos),
    region AS (SELECT image_id, pos, min(root) AS root FROM reach GROUP BY ALL),
    area AS (SELECT image_id, root, count(*) AS area FROM region GROUP BY ALL),
    bounds AS (SELECT category, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY ALL),
    binned AS (SELECT p.category, p.image_id, r.root, a.area, CAST(least(200, greatest(0, ceil((v - lo) / ((hi - lo) / 200)))) AS INTEGER) AS bin FROM pixels p JOIN bounds b ON b.category = p.category
      LEFT JOIN region r ON r.image_id = p.image_id AND r.pos = p.pos LEFT JOIN area a ON a.image_id = r.image_id AND a.root = r.root),
    totals AS (SELECT category, count(DISTINCT CASE WHEN root IS NOT NULL THEN image_id * 64 + root END) AS regions, count(*) FILTER (root IS NULL) AS negatives FROM binned GROUP BY ALL),
    hist AS (SELECT category, bin, coalesce(sum(1.0::DOUBLE / area) FILTER (root IS NOT NULL), 0) AS recall, count(*) FILTER (root IS NULL) AS outside FROM binned GROUP BY ALL),
    dense AS (SELECT category, b AS bin, coalesce(recall, 0) AS recall, coalesce(outside, 0) AS outside FROM (SELECT category, unnest(range(201)) AS b FROM bounds) e LEFT JOIN hist h USING (category) WHERE h.bin = b
      UNION ALL SELECT category, b, 0, 0 FROM (SELECT category, unnest(range(201)) AS b FROM bounds) e WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.category = e.category AND h.bin = e.b)),
    curve AS (SELECT category, bin - 1 AS t, sum(recall) OVER w / regions AS pro, sum(outside) OVER w / negatives AS fpr FROM dense JOIN totals USING (category) WINDOW w AS (PARTITION BY category ORDER BY bin DESC)),
    cut AS (SELECT *, min(fpr) OVER (PARTITION BY category) AS f0, max(fpr) OVER (PARTITION BY category) AS f1 FROM curve WHERE t >= 0 AND fpr < 0.3::DOUBLE),
    piece AS (SELECT category, ((fpr - f0) / (f1 - f0) - lead((fpr - f0) / (f1 - f0)) OVER w) * (pro + lead(pro) OVER w) / 2 AS p FROM cut WINDOW w AS (PARTITION BY category ORDER BY t))
    SELECT category, round(sum(p), 6) AS pro_area FROM piece GROUP BY category""",
)
def region_overlap_area(spark, folder):
    return R.region_overlap_area(heatmaps(spark, folder)).select("category", F.round("pro_area", 6).alias("pro_area"))

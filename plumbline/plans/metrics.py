"""Answer accuracy and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.plans.fixtures import PIXELS_SQL, QA_SQL, SCORES_SQL, heatmaps, qa, scores
from plumbline.plans.registry import query

ANSWERS_SQL = (
    "WITH "
    + QA_SQL
    + """, answers AS (
  SELECT *, correct_answer = given_answer AS correct,
         list_contains(string_split(image_path, '/'), 'good') OR contains(string_split(image_path, '/')[-2], 'good') AS is_normal
  FROM qa),
counts AS (
  SELECT subclass, task_type, count(*) AS total, count(*) FILTER (correct) AS correct,
         count(*) FILTER (is_normal) AS normal_total, count(*) FILTER (is_normal AND correct) AS normal_correct,
         count(*) FILTER (NOT is_normal) AS abnormal_total, count(*) FILTER (NOT is_normal AND correct) AS abnormal_correct,
         count(*) FILTER (NOT correct) AS wrong_count
  FROM answers GROUP BY ALL),
rated AS (
  SELECT *, correct / total * 100 AS accuracy,
    coalesce(normal_correct / nullif(normal_total, 0), 0) AS na, coalesce(abnormal_correct / nullif(abnormal_total, 0), 0) AS aa
  FROM counts),
balanced AS (
  SELECT *, CASE WHEN normal_total > 0 AND abnormal_total > 0 THEN (na + aa) / 2 WHEN normal_total > 0 THEN na ELSE aa END * 100 AS ba
  FROM rated)
"""
)


def answers(spark, folder):
    parts = F.split("image_path", "/")
    return qa(spark, folder).withColumns(
        {
            "correct": F.col("correct_answer") == F.col("given_answer"),
            "is_normal": F.array_contains(parts, "good") | F.element_at(parts, -2).contains("good"),
        }
    )


@query("agg1_answer_counts", ANSWERS_SQL + "SELECT * FROM counts")
def answer_counts(spark, folder):
    return metrics.answer_counts(answers(spark, folder))


@query(
    "agg2_balanced_accuracy",
    ANSWERS_SQL
    + """SELECT subclass, task_type, total, correct, wrong_count, round(accuracy, 2) AS accuracy, round(ba, 2) AS balanced_accuracy,
      round(na * 100, 2) AS normal_accuracy, round(aa * 100, 2) AS abnormal_accuracy FROM balanced""",
)
def balanced_accuracy(spark, folder):
    out = metrics.answer_accuracy(metrics.answer_counts(answers(spark, folder)))
    rated = [F.round(c, 2).alias(c) for c in ("accuracy", "balanced_accuracy", "normal_accuracy", "abnormal_accuracy")]
    return out.select("subclass", "task_type", "total", "correct", "wrong_count", *rated)


@query(
    "agg3_accuracy_rollup",
    ANSWERS_SQL
    + """SELECT subclass, task_type, CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct,
      round(sum(correct) / sum(total) * 100, 6) AS accuracy, round(avg(ba), 6) AS mean_balanced_accuracy
      FROM balanced GROUP BY GROUPING SETS ((subclass, task_type), (subclass), (task_type), ())""",
)
def accuracy_rollup(spark, folder):
    out = metrics.answer_rollup(metrics.answer_counts(answers(spark, folder)))
    return out.select(
        "subclass",
        "task_type",
        "total",
        "correct",
        F.round("accuracy", 6).alias("accuracy"),
        F.round("mean_balanced_accuracy", 6).alias("mean_balanced_accuracy"),
    )


RANKED_SQL = """, labelled AS (SELECT category, score, label FROM scores WHERE split = 'test'),
by_score AS (SELECT category, score, sum(label) AS pos, sum(1 - label) AS neg FROM labelled GROUP BY ALL),
running AS (
  SELECT *, sum(neg) OVER (PARTITION BY category ORDER BY score) AS neg_upto, sum(pos) OVER (PARTITION BY category ORDER BY score) AS pos_upto,
         sum(pos) OVER (PARTITION BY category) AS p, sum(neg) OVER (PARTITION BY category) AS n FROM by_score)
"""


@query(
    "agg8_image_auroc",
    "WITH "
    + SCORES_SQL
    + RANKED_SQL
    + "SELECT category, round(sum(pos * (neg_upto - neg + neg / 2)) / (max(p) * max(n)), 6) AS auroc FROM running GROUP BY category",
)
def image_auroc(spark, folder):
    rows = scores(spark, folder).where(F.col("split") == "test")
    return metrics.auroc(rows, ["category"]).select("category", F.round("auroc", 6).alias("auroc"))


@query(
    "agg9_average_precision",
    "WITH "
    + SCORES_SQL
    + RANKED_SQL
    + """SELECT category, round(sum(pos * (p - pos_upto + pos) / (p - pos_upto + pos + n - neg_upto + neg)) / max(p), 6)
         AS average_precision FROM running GROUP BY category""",
)
def average_precision(spark, folder):
    rows = scores(spark, folder).where(F.col("split") == "test")
    out = metrics.average_precision(rows, ["category"])
    return out.select("category", F.round("average_precision", 6).alias("average_precision"))


@query(
    "agg10_pixel_auroc",
    "WITH "
    + PIXELS_SQL
    + """, by_score AS (
      SELECT category, v, count(*) FILTER (on_mask) AS pos, count(*) FILTER (NOT on_mask) AS neg FROM pixels GROUP BY ALL),
    running AS (SELECT *, sum(neg) OVER (PARTITION BY category ORDER BY v) AS upto,
      sum(pos) OVER (PARTITION BY category) AS p, sum(neg) OVER (PARTITION BY category) AS n FROM by_score)
    SELECT category, round(sum(pos * (upto - neg + neg / 2)) / (max(p) * max(n)), 6) AS auroc FROM running GROUP BY category""",
)
def pixel_auroc(spark, folder):
    pixels = heatmaps(spark, folder).select(
        "category", F.explode(F.arrays_zip("vals", "mask")).alias("p")
    ).select("category", F.col("p.vals").alias("score"), F.col("p.mask").cast("int").alias("label"))
    return metrics.auroc(pixels, ["category"]).select("category", F.round("auroc", 6).alias("auroc"))



"""Calibration, threshold decisions and their summaries over scored images."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import calibrate as cal
from plumbline.operators import metrics
from plumbline.operators.decide import decide
from plumbline.operators.joins import attach, literal_lookup, look_up
from plumbline.operators.ranks import exact_quantiles, near_smallest
from plumbline.plans.fixtures import PREDICTIONS_SQL, SCORES_SQL, predictions, scores
from plumbline.plans.registry import query

KEYS = ["dataset", "category"]

STATS_SQL = (
    "WITH "
    + SCORES_SQL
    + """, train AS (SELECT * FROM scores WHERE split = 'train'),
test AS (SELECT * FROM scores WHERE split = 'test'),
base AS (
  SELECT dataset, category, count(score) AS n, median(score) AS med, quantile_cont(score, 0.995) AS q,
         max(score) AS max_score
  FROM train GROUP BY ALL),
spread AS (
  SELECT t.dataset, t.category, median(abs(t.score - b.med)) AS mad
  FROM train t JOIN base b USING (dataset, category) GROUP BY ALL),
stats AS (SELECT * FROM base JOIN spread USING (dataset, category)),
calibration AS (
  SELECT *, CASE WHEN n < 5 THEN greatest(q, med + 6 * 1.4826 * mad, max_score)
                 ELSE greatest(q, med + 6 * 1.4826 * mad) END AS threshold FROM stats),
decided AS (
  SELECT t.*, c.threshold, CAST(t.score > c.threshold AS INTEGER) AS prediction,
         CAST(t.score > c.threshold AS INTEGER) = t.label AS correct
  FROM test t JOIN calibration c USING (dataset, category)),
summary AS (
  SELECT dataset, category, count(*) AS total, count(*) FILTER (label = 0) AS normal_total,
         count(*) FILTER (label = 1) AS anomaly_total, count(*) FILTER (correct) AS correct,
         coalesce(count(*) FILTER (correct) / nullif(count(*), 0), 0.0::DOUBLE) AS accuracy,
         coalesce(count(*) FILTER (correct AND label = 0) / nullif(count(*) FILTER (label = 0), 0), 0.0::DOUBLE)
           AS normal_accuracy,
         coalesce(count(*) FILTER (correct AND label = 1) / nullif(count(*) FILTER (label = 1), 0), 0.0::DOUBLE)
           AS anomaly_accuracy
  FROM decided GROUP BY ALL)
"""
)


def _train(spark, folder):
    return scores(spark, folder).where(F.col("split") == "train")


def _test(spark, folder):
    return scores(spark, folder).where(F.col("split") == "test")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "cal1_calibration_rows",
    "WITH "
    + SCORES_SQL
    + """ SELECT dataset, category, image_path, score FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset, category ORDER BY image_path) AS place
      FROM scores WHERE split = 'train') WHERE place <= 16""",
)
def calibration_rows(spark, folder):
    return cal.calibration_rows(_train(spark, folder), 16).select("dataset", "category", "image_path", "score")


@query(
    "cal2_quantile_threshold",
    STATS_SQL + "SELECT dataset, category, n, round(q, 6) AS threshold FROM stats",
)
def quantile_threshold(spark, folder):
    out = exact_quantiles(_train(spark, folder), KEYS, "score", {"threshold": 0.995})
    return _rounded(out, "threshold").drop("max_value")


@query(
    "cal3_median_mad_threshold",
    STATS_SQL
    + """SELECT dataset, category, n, round(med, 6) AS median, round(mad, 6) AS mad,
         round(med + 6 * 1.4826 * mad, 6) AS threshold, 'median+6*1.4826*MAD' AS threshold_policy FROM stats""",
)
def median_mad_threshold(spark, folder):
    out = cal.calibrate(_train(spark, folder), policy="normal_median_mad")
    return _rounded(out.select(*KEYS, "n", "median", "mad", "threshold", "threshold_policy"), "median", "mad", "threshold")


ROBUST_SQL = """SELECT dataset, category, n, round(med, 6) AS median, round(mad, 6) AS mad, round(q, 6) AS quantile,
  max_score, round(threshold, 6) AS threshold,
  CASE WHEN n < 5 THEN 'max(q0.995, median+6*1.4826*MAD); small_n_floor=max_train_score'
       ELSE 'max(q0.995, median+6*1.4826*MAD)' END AS threshold_policy
  FROM calibration"""


@query("cal4_robust_threshold", STATS_SQL + ROBUST_SQL)
def robust_threshold(spark, folder):
    out = cal.calibrate(_train(spark, folder)).drop("calibration_shots")
    return _rounded(out, "median", "mad", "quantile", "threshold")


@query(
    "cal4_small_sample_floor",
    (
        STATS_SQL.replace(
            "train AS (SELECT * FROM scores WHERE split = 'train')",
            """train AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (
      PARTITION BY dataset, category ORDER BY image_path) AS place FROM scores WHERE split = 'train') WHERE place <= 4)""",
        )
        + ROBUST_SQL
    ),
)
def small_sample_floor(spark, folder):
    out = cal.calibrate(_train(spark, folder), shots=4).drop("calibration_shots")
    return _rounded(out, "median", "mad", "quantile", "threshold")


@query(
    "cal5_preset_thresholds",
    STATS_SQL
    + """, wanted AS (SELECT DISTINCT dataset, category FROM test UNION SELECT 'set9', 'cat9'),
    given AS (SELECT * FROM (VALUES ('set0', 'cat0', 12.25::DOUBLE, 'snapshot'), ('set1', 'cat1', 0.5::DOUBLE, '')) g(dataset, category, t, s))
    SELECT w.dataset, w.category, coalesce(n, 0) AS n, round(coalesce(med, 0), 6) AS median, round(coalesce(mad, 0), 6) AS mad,
      round(coalesce(q, 0), 6) AS quantile, coalesce(max_score, 0.0::DOUBLE) AS max_score,
      coalesce(t, 0.5::DOUBLE) AS threshold,
      'table(' || coalesce(nullif(s, ''), 'binary_ad_threshold_table') || ':' ||
        CASE w.category WHEN 'cat0' THEN '12.25' ELSE '0.5' END || ')' AS threshold_policy
    FROM wanted w LEFT JOIN stats USING (dataset, category) LEFT JOIN given g USING (dataset, category)""",
)
def preset_thresholds(spark, folder):
    extra = spark.createDataFrame([("set9", "cat9")], "dataset string, category string")
    wanted = _test(spark, folder).select(*KEYS).distinct().union(extra)
    given = spark.createDataFrame(
        [("set0", "cat0", 12.25, "snapshot"), ("set1", "cat1", 0.5, "")],
        "dataset string, category string, threshold double, source string",
    )
    out = cal.preset_thresholds(wanted, _train(spark, folder), table=given)
    return _rounded(out, "median", "mad", "quantile")


@query(
    "cal5_fixed_threshold",
    STATS_SQL
    + """SELECT dataset, category, n, round(med, 6) AS median, 42.5::DOUBLE AS threshold,
      'fixed(42.5)' AS threshold_policy FROM stats""",
)
def fixed_threshold(spark, folder):
    wanted = _test(spark, folder).select(*KEYS).distinct()
    out = cal.preset_thresholds(wanted, _train(spark, folder), fixed=42.5)
    return _rounded(out.select(*KEYS, "n", "median", "threshold", "threshold_policy"), "median")


TABLE_ROWS = [
    (0, "set0", "cat0", None, None, 10.0, "any"),
    (1, "set0", "cat0", "main", 1, 20.0, "exact"),
    (2, "set0", "cat0", "main", None, 30.0, "later"),
    (3, "set1", "cat1", "other", 0, 40.0, ""),
    (4, "set1", "cat1", "", 0, 50.0, "wild"),
    (5, "set2", "cat2", "main", 1, 60.0, "shot1"),
    (6, "set2", "cat2", "main", 2, 70.0, "shot2"),
    (7, "set0", "cat3", "", None, 80.0, "whole"),
]
TABLE_SCHEMA = "ordinal int, dataset string, category string, localizer string, shot int, threshold double, source string"


def _sql_value(value, kind):
    return f"CAST(NULL AS {kind})" if value is None else repr(value) if isinstance(value, str) else f"{value}::{kind}"


TABLE_VALUES = ", ".join(
    "("
    + ", ".join(
        _sql_value(v, k) for v, k in zip(row, ("INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "INTEGER", "DOUBLE", "VARCHAR"))
    )
    + ")"
    for row in TABLE_ROWS
)


@query(
    "cal6_threshold_lookup",
    "WITH "
    + SCORES_SQL
    + f""", rows_t AS (SELECT * FROM (VALUES {TABLE_VALUES}) t(ordinal, dataset, category, localizer, shot, threshold, source)),
    requests AS (
      SELECT ordinal AS request_id, dataset, category,
             CASE ordinal % 3 WHEN 0 THEN 'Main' WHEN 1 THEN '' ELSE 'other' END AS localizer,
             CASE WHEN ordinal % 4 = 3 THEN NULL ELSE CAST(ordinal % 4 AS INTEGER) END AS shot
      FROM scores),
    fits AS (
      SELECT q.request_id, r.ordinal, r.threshold, r.source,
             lower(coalesce(r.localizer, '')) = lower(q.localizer) AS exact
      FROM requests q JOIN rows_t r ON r.dataset = q.dataset AND r.category = q.category
      WHERE (coalesce(r.localizer, '') = '' OR q.localizer = '' OR lower(r.localizer) = lower(q.localizer))
        AND (r.shot IS NULL OR q.shot IS NULL OR r.shot = q.shot)),
    best AS (
      SELECT request_id, coalesce(min(ordinal) FILTER (exact), max(ordinal)) AS ordinal FROM fits GROUP BY request_id)
    SELECT q.request_id, r.threshold,
           CASE WHEN r.threshold IS NULL THEN '' ELSE coalesce(nullif(r.source, ''), 'threshold_table') END AS threshold_source
    FROM requests q LEFT JOIN best b USING (request_id) LEFT JOIN rows_t r ON r.ordinal = b.ordinal""",
)
def threshold_lookup(spark, folder):
    ordinal = F.col("ordinal")
    names = F.array(F.lit("Main"), F.lit(""), F.lit("other"))
    requests = scores(spark, folder).select(
        ordinal.alias("request_id"),
        "dataset",
        "category",
        F.get(names, (ordinal % 3).cast("int")).alias("localizer"),
        F.when(ordinal % 4 != 3, (ordinal % 4).cast("int")).alias("shot"),
    )
    return cal.lookup_thresholds(requests, F.broadcast(spark.createDataFrame(TABLE_ROWS, TABLE_SCHEMA)))


@query(
    "dec1_threshold_decision",
    STATS_SQL
    + "SELECT dataset, category, image_path, label, score, round(threshold, 6) AS threshold, prediction, correct FROM decided",
)
def threshold_decision(spark, folder):
    rows = scores(spark, folder)
    thresholds = cal.calibrate(rows.where(F.col("split") == "train"))
    out = decide(rows.where(F.col("split") == "test"), thresholds)
    return _rounded(
        out.select(*KEYS, "image_path", "label", "score", "threshold", "prediction", "correct"), "threshold"
    )


def _summary(spark, folder):
    rows = scores(spark, folder)
    thresholds = cal.calibrate(rows.where(F.col("split") == "train"))
    return metrics.category_summary(decide(rows.where(F.col("split") == "test"), thresholds))


@query(
    "agg4_category_summary",
    STATS_SQL
    + """SELECT dataset, category, total, normal_total, anomaly_total, correct, round(accuracy, 6) AS accuracy,
       round(normal_accuracy, 6) AS normal_accuracy, round(anomaly_accuracy, 6) AS anomaly_accuracy FROM summary""",
)
def category_summary(spark, folder):
    return _rounded(_summary(spark, folder), "accuracy", "normal_accuracy", "anomaly_accuracy")


@query(
    "agg5_pipeline_summary",
    STATS_SQL
    + """, sets AS (
      SELECT dataset, count(*) AS category_count, CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct,
             sum(correct) / sum(total) AS accuracy FROM summary GROUP BY dataset)
    SELECT count(*) AS dataset_count, CAST(sum(category_count) AS BIGINT) AS category_count,
      CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct,
      round(sum(correct) / sum(total), 6) AS accuracy, round(avg(accuracy), 6) AS macro_dataset_accuracy FROM sets""",
)
def pipeline_summary(spark, folder):
    out = metrics.pipeline_summary(metrics.dataset_summary(_summary(spark, folder)))
    return _rounded(out, "accuracy", "macro_dataset_accuracy")


@query(
    "agg6_discovery_summary",
    "WITH "
    + SCORES_SQL
    + """ SELECT dataset, category, count(*) FILTER (split = 'train') AS train_normal,
      count(*) FILTER (split = 'test') AS test_total, count(*) FILTER (split = 'test' AND label = 0) AS test_normal,
      count(*) FILTER (split = 'test' AND label = 1) AS test_anomaly,
      coalesce(string_agg(DISTINCT defect_type, ',' ORDER BY defect_type) FILTER (split = 'test'), '') AS defect_types
    FROM scores GROUP BY ALL""",
)
def discovery_summary(spark, folder):
    out = metrics.discovery_summary(scores(spark, folder))
    return out.withColumn("defect_types", F.array_join("defect_types", ","))


@query(
    "agg7_combined_outputs",
    "WITH "
    + PREDICTIONS_SQL
    + """, parts AS (
      SELECT *, coalesce(try_cast(substr(category, 4) AS INTEGER), 0) AS part FROM predictions),
    kept AS (SELECT *, prediction = label AS correct FROM parts
             WHERE dataset || category NOT IN (SELECT dataset || category FROM parts GROUP BY ALL HAVING max(part) = 4)),
    cats AS (SELECT dataset, category, count(*) AS total, count(*) FILTER (correct) AS correct FROM kept GROUP BY ALL)
    SELECT dataset, count(*) AS category_count, CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct,
           round(sum(correct) / sum(total), 6) AS accuracy FROM cats GROUP BY dataset""",
)
def combined_outputs(spark, folder):
    """Per-category outputs are merged into dataset rows; a category whose job failed is left out."""
    rows = predictions(spark, folder).withColumn("correct", F.col("prediction") == F.col("label"))
    failed = spark.createDataFrame([("cat4",)], "category string")
    kept = rows.join(F.broadcast(failed), "category", "left_anti")
    return _rounded(metrics.dataset_summary(metrics.category_summary(kept)), "accuracy")


@query(
    "jn1_test_with_train_category",
    "WITH "
    + SCORES_SQL
    + """ SELECT dataset, category, image_path FROM scores WHERE split = 'test' AND (dataset, category) IN (
        SELECT (dataset, category) FROM scores WHERE split = 'train' GROUP BY ALL HAVING count(*) >= 1)""",
)
def test_with_train_category(spark, folder):
    rows = scores(spark, folder)
    seen = rows.where(F.col("split") == "train").select(*KEYS).distinct()
    return attach(rows.where(F.col("split") == "test"), seen, KEYS, "left_semi").select(*KEYS, "image_path")


@query(
    "jn10_category_union",
    "WITH "
    + SCORES_SQL
    + """, a AS (SELECT dataset, category, count(*) AS train_rows FROM scores WHERE split = 'train' AND category <> 'cat2' GROUP BY ALL),
    b AS (SELECT dataset, category, count(*) AS test_rows FROM scores WHERE split = 'test' AND category <> 'cat5' GROUP BY ALL)
    SELECT dataset, category, coalesce(train_rows, 0) AS train_rows, coalesce(test_rows, 0) AS test_rows
    FROM a FULL JOIN b USING (dataset, category)""",
)
def category_union(spark, folder):
    rows = scores(spark, folder)
    train = rows.where((F.col("split") == "train") & (F.col("category") != "cat2")).groupBy(*KEYS)
    test = rows.where((F.col("split") == "test") & (F.col("category") != "cat5")).groupBy(*KEYS)
    return (
        train.agg(F.count(F.lit(1)).alias("train_rows"))
        .join(test.agg(F.count(F.lit(1)).alias("test_rows")), KEYS, "full")
        .fillna(0, ["train_rows", "test_rows"])
    )


@query(
    "win1_normal_references",
    STATS_SQL
    + """SELECT dataset, category, image_path, score, place FROM (
      SELECT t.dataset, t.category, t.image_path, t.score, row_number() OVER (
        PARTITION BY dataset, category ORDER BY abs(t.score - b.med), t.score, t.image_path) AS place
      FROM train t JOIN base b USING (dataset, category)) WHERE place <= 3""",
)
def normal_references(spark, folder):
    return normal_reference_rows(_train(spark, folder), 3).select(*KEYS, "image_path", "score", F.col("place").cast("long"))


def normal_reference_rows(train, max_refs: int):
    """Rows closest to their category's median; ties by score, then path."""
    middle = exact_quantiles(train, KEYS, "score", {"median": 0.5}).select(*KEYS, "median")
    wanted = max(1, max_refs)
    away = look_up(train, middle, KEYS).withColumn("_away", F.abs(F.col("score") - F.col("median")))
    order = W.partitionBy(*KEYS).orderBy(F.col("_away").asc_nulls_last(), "score", "image_path")
    near = near_smallest(away, KEYS, "_away", wanted, ["image_path"])
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).drop("_away")


@query(
    "jn3_lookup_with_default",
    "WITH "
    + SCORES_SQL
    + """, t AS (SELECT * FROM (VALUES ('set0', 1, 'strict'), ('set1', 3, 'loose')) v(dataset, shots, mode))
    SELECT image_path, coalesce(shots, 0) AS shots, coalesce(mode, 'default') AS mode FROM scores LEFT JOIN t USING (dataset)""",
)
def lookup_with_default(spark, folder):
    given = spark.createDataFrame([("set0", 1, "strict"), ("set1", 3, "loose")], "dataset string, shots int, mode string")
    out = literal_lookup(scores(spark, folder).select("image_path", "dataset"), given, "dataset")
    return out.select("image_path", F.coalesce("shots", F.lit(0)).alias("shots"), F.coalesce("mode", F.lit("default")).alias("mode"))

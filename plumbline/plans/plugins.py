"""Plug points, augmentation and streaming jobs over the given tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import answers as A
from plumbline.functions import arrays as AR
from plumbline.operators import calibrate as cal
from plumbline.operators import plugins as P
from plumbline.plans.calibration import STATS_SQL
from plumbline.plans.fixtures import HEATMAPS_SQL, SCORES_SQL, heatmaps, scores
from plumbline.plans.metrics import ANSWERS_SQL
from plumbline.plans.registry import query, table
from plumbline.session import ensure_checkpoint_dir
from plumbline.streaming import jobs


def _scorer():
    def score(row):
        if row.image_id % 50 == 7:
            raise ValueError("unreadable image")
        heat = np.asarray(row.vals).reshape(row.height, row.width)
        return heat, float(heat.max()) if row.image_id % 2 else None, row.category

    return score


SCORED_SQL = "WITH " + HEATMAPS_SQL


@query(
    "udf1_scored_images",
    SCORED_SQL
    + """ SELECT image_id, round(CASE WHEN image_id % 50 = 7 THEN NULL WHEN image_id % 2 = 1 THEN list_max(vals) ELSE list_reverse_sort(vals)[1] END, 6) AS score,
      CASE WHEN image_id % 50 = 7 THEN '' WHEN image_id % 2 = 1 THEN 'localizer_image_score' ELSE 'heatmap_tail_score' END AS score_source FROM heatmaps""",
)
def scored_images(spark, folder):
    rows = P.score_images(heatmaps(spark, folder).drop("mask"), _scorer)
    got = rows.withColumn("tail", AR.tail_mean(F.col("vals"))).withColumn("s", AR.select_score(F.col("image_score"), F.col("tail")))
    ok = F.col("error").isNull()
    return got.select(
        "image_id", F.when(ok, F.round("s.score", 6)).alias("score"), F.when(ok, F.col("s.score_source")).otherwise("").alias("score_source")
    )


@query(
    "udf6_error_rows",
    SCORED_SQL + " SELECT image_id, 'ValueError: unreadable image' AS error FROM heatmaps WHERE image_id % 50 = 7",
)
def error_rows(spark, folder):
    rows = P.score_images(heatmaps(spark, folder).drop("mask"), _scorer)
    return rows.where("error is not null").select("image_id", "error")


def _centre_distance(support):
    centre = np.array(support, dtype=np.float64).mean(axis=0)
    return lambda matrix: np.abs(matrix - centre).sum(axis=1)


@query(
    "udf2_category_setup",
    """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 4),
    c AS (SELECT label, d, avg(CAST(embedding[d] AS DOUBLE)) AS m FROM s, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL)
    SELECT vec_id AS image_id, e.label AS category, round(sum(abs(CAST(embedding[d] AS DOUBLE) - m)), 6) AS score FROM embeddings e JOIN c ON c.label = e.label GROUP BY ALL""",
)
def category_setup(spark, folder):
    from plumbline.operators.vectors import first_per_category

    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("category"), F.col("embedding").alias("vec"))
    support = first_per_category(rows, 4, order="image_id")
    out = P.score_with_support(rows, support, _centre_distance)
    return out.select("image_id", "category", F.round("score", 6).alias("score"))


def _verifier():
    def ask(pdf):
        return ['{"prediction": "anomaly", "confidence": 0.75}' if s > 40 else "looks normal" for s in pdf["score"]]

    return ask


@query(
    "udf3_verified",
    "WITH "
    + SCORES_SQL
    + """ SELECT image_path, CASE WHEN score > 40 THEN 'json' ELSE 'keyword' END AS parse_status, CAST(score > 40 AS INTEGER) AS prediction, CASE WHEN score > 40 THEN 0.75::DOUBLE END AS confidence FROM scores WHERE split = 'test'""",
)
def verified(spark, folder):
    rows = scores(spark, folder).where("split = 'test'").select("image_path", "score", F.lit(0).alias("fallback"))
    out = A.parse_verifier(P.verify(rows, _verifier), "raw", "fallback")
    return out.select("image_path", "parse_status", "prediction", "confidence")


def _letter_encoder():
    def encode(texts):
        return [[float(len(t)), float(sum(c == "e" for c in t))] for t in texts]

    return encode


@query(
    "udf4_encoded_texts",
    "SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS size, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS DOUBLE) AS letters FROM part",
)
def encoded_texts(spark, folder):
    out = P.encode_texts(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", _letter_encoder)
    return out.select("p_partkey", F.get("vec", F.lit(0)).alias("size"), F.get("vec", F.lit(1)).alias("letters"))


@query(
    "udf5_mask_audit",
    SCORED_SQL
    + """, m AS (SELECT image_id, CASE WHEN image_id % 6 = 1 THEN 64 WHEN image_id % 6 = 2 THEN 0 ELSE len(list_filter(mask, lambda b: b)) END AS area, image_id % 4 AS proposals, image_id % 9 = 0 AS failed FROM heatmaps),
    s AS (SELECT *, CASE WHEN proposals <= 0 THEN 'no_region_proposal' WHEN failed THEN 'error' WHEN area / 64 > 0.85::DOUBLE THEN 'overlarge_mask_rejected' WHEN area > 0 THEN 'box_prompt_refinement' ELSE 'invalid_mask' END AS status FROM m)
    SELECT image_id, status, status = 'box_prompt_refinement' AS mask_valid, CAST(area AS INTEGER) AS area_pixels FROM s""",
)
def mask_audit(spark, folder):
    image = F.col("image_id")
    mask = F.transform("mask", lambda m: F.when(image % 6 == 1, True).when(image % 6 == 2, False).otherwise(m))
    rows = heatmaps(spark, folder).select(
        "image_id",
        (image % 4).alias("proposal_count"),
        mask.alias("mask"),
        "width",
        "height",
        F.lit(0.5).alias("mask_score"),
        F.when(image % 9 == 0, "timeout").alias("error"),
    )
    return P.mask_audit(rows).drop("mask_score")


# --- streaming: the source is a table folder, everything available is processed --------


def _place(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _stream(spark, folder, name):
    """The table as a stream of its parquet file (a glob, since a stream reads folders)."""
    return jobs.read_rows(spark, f"{folder}/{name}*.parquet", table(spark, folder, name).schema)


def _streamed_scores(spark, folder):
    user = F.col("user_id")
    return _stream(spark, folder, "events").select(
        F.concat(F.lit("set"), (user % 7 % 3).cast("string")).alias("dataset"),
        F.concat(F.lit("cat"), (user % 7).cast("string")).alias("category"),
        F.concat(F.lit("img/"), F.col("event_id").cast("string"), F.lit(".png")).alias("image_path"),
        F.col("event_type").isin("click", "view").alias("is_train"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("value").alias("score"),
        F.col("event_id").alias("ordinal"),
    )


@query(
    "str1_appended_log",
    "WITH " + SCORES_SQL + " SELECT image_path, score, label FROM scores WHERE split = 'test'",
)
def appended_log(spark, folder):
    rows = _streamed_scores(spark, folder).where("not is_train").select("image_path", "score", "label")
    out = _place(spark, "log")
    jobs.append_log(rows, out, _place(spark, "log-state")).awaitTermination()
    return spark.read.schema("image_path string, score double, label int").json(out)


@query(
    "str2_unseen_images",
    """SELECT 'img/' || CAST(user_id AS VARCHAR) AS image_path, user_id AS uid FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) GROUP BY user_id""",
)
def unseen_images(spark, folder):
    path = lambda c: F.concat(F.lit("img/"), F.col(c).cast("string")).alias("image_path")
    rows = _stream(spark, folder, "events").select(path("user_id"), F.col("user_id").alias("uid"))
    history = table(spark, folder, "customer").where("c_acctbal < 2000").select(path("c_custkey"))
    out = _place(spark, "unseen")
    jobs.append_unseen(rows, out, _place(spark, "unseen-state"), history).awaitTermination()
    return spark.read.parquet(out).select("image_path", "uid")


@query(
    "str3_latest_rows",
    "SELECT 'img/' || CAST(user_id AS VARCHAR) AS image_path, max(event_id) AS ordinal, arg_max(value, event_id) AS score FROM events GROUP BY user_id",
)
def latest_rows(spark, folder):
    rows = _stream(spark, folder, "events").select(
        F.concat(F.lit("img/"), F.col("user_id").cast("string")).alias("image_path"), F.col("event_id").alias("ordinal"), F.col("value").alias("score")
    )
    out = _place(spark, "latest")
    jobs.upsert_latest(rows, out, _place(spark, "latest-state")).awaitTermination()
    return jobs.latest_rows(spark, out).select("image_path", "ordinal", "score")


@query(
    "str4_streamed_decisions",
    STATS_SQL + "SELECT image_path, label, prediction, correct FROM decided",
)
def streamed_decisions(spark, folder):
    thresholds = cal.calibrate(scores(spark, folder).where("split = 'train'")).select("dataset", "category", "threshold")
    rows = jobs.decided(_streamed_scores(spark, folder).where("not is_train"), F.broadcast(thresholds))
    out = _place(spark, "decided")
    jobs.append_log(rows.select("image_path", "label", "prediction", "correct"), out, _place(spark, "decided-state")).awaitTermination()
    return spark.read.schema("image_path string, label int, prediction int, correct boolean").json(out)


@query(
    "str5_running_accuracy",
    ANSWERS_SQL + "SELECT subclass, count(*) AS total, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM answers GROUP BY subclass",
)
def running_accuracy(spark, folder):
    conv = F.col("conv_id")
    rows = _stream(spark, folder, "conversations").select(
        F.concat(F.lit("part"), (conv % 5).cast("string")).alias("subclass"), ((conv % 4) == ((conv + F.length("text")) % 4)).alias("correct")
    )
    out = _place(spark, "totals")
    jobs.write_versions(jobs.running_accuracy(rows, ("subclass",)), out, _place(spark, "totals-state")).awaitTermination()
    return jobs.latest_version(spark, out).select("subclass", "total", "correct", F.round("accuracy", 6).alias("accuracy"))

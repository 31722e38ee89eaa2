"""Plug points for a user's own models, with errors kept as rows.

A plug is made once per task by a factory and is handed whole Arrow batches; what Spark
does around it is the partitioning, the joins and the decisions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arrays import mask_stats

SCORE_SCHEMA = "image_id long, height int, width int, vals array<double>, image_score double, category string, error string"


def score_images(images: DataFrame, factory: Callable[[], Callable], schema: str = SCORE_SCHEMA) -> DataFrame:
    """Scorer plug: ``factory()`` gives ``f(row) -> (2-D map, image score or None, category)``.

    A row that fails becomes an error row; the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                try:
                    heat, image_score, category = score(row)
                    heat = np.asarray(heat, dtype=np.float64)
                    rows.append((row.image_id, *heat.shape, heat.ravel().tolist(), image_score, category, None))
                except Exception as problem:  # noqa: BLE001 - the error is the row's result
                    rows.append((row.image_id, 0, 0, [], None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])

    return images.mapInPandas(run, schema)


def score_with_support(
    images: DataFrame, support: DataFrame, factory: Callable[[list], Callable], *, block: int = 10_000
) -> DataFrame:
    """Category set-up plug: ``factory(support vectors) -> f(matrix) -> scores``, set up per category.

    ``images``: category, image_id, vec. ``support``: category, image_id, vec (few per category).
    A large category is split into blocks of images, and its support goes to each of them.
    """
    n = images.groupBy("category").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    from plumbline.operators.joins import attach

    left = attach(images.select("category", "image_id", "vec"), n, ["category"])
    left = left.withColumn("_b", F.pmod(F.xxhash64("image_id"), F.col("_n"))).drop("_n").toDF("category", "image_id", "vec", "_b")
    right = attach(support.select("category", F.col("image_id").alias("at"), "vec"), n, ["category"])
    right = right.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)))
    right = right.select("category", "at", "vec", "_b").toDF("category", "at", "vec", "_b")

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if ours.empty:
            return pd.DataFrame(columns=["category", "image_id", "score"])
        score = factory(theirs.sort_values("at")["vec"].tolist())
        values = score(np.array(ours["vec"].tolist(), dtype=np.float64))
        return pd.DataFrame({"category": ours["category"], "image_id": ours["image_id"], "score": values})

    kind = images.schema["category"].dataType.simpleString()
    return left.groupBy("category", "_b").cogroup(right.groupBy("category", "_b")).applyInPandas(
        run, f"category {kind}, image_id long, score double"
    )


def verify(rows: DataFrame, factory: Callable[[], Callable], column: str = "raw") -> DataFrame:
    """Verifier plug: ``factory()`` gives ``f(batch) -> raw responses``; parse them with ``parse_verifier``."""
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.StringType())])

    def run(batches):
        ask = factory()
        for pdf in batches:
            yield pdf.assign(**{column: list(ask(pdf))})

    return rows.mapInPandas(run, schema)


def encode_texts(rows: DataFrame, text: str, factory: Callable[[], Callable]) -> DataFrame:
    """Text encoder plug over distinct texts only, joined back as ``vec``."""

    def run(batches):
        encode = factory()
        for pdf in batches:
            yield pd.DataFrame({text: pdf[text], "vec": [np.asarray(v, dtype=float).tolist() for v in encode(pdf[text].tolist())]})

    vectors = rows.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"{text} string, vec array<double>")
    return rows.join(vectors, text, "left")


def mask_audit(rows: DataFrame, configured: Column | None = None) -> DataFrame:
    """Status of a mask provider's answer.

    ``rows``: image_id, proposal_count, mask, width, height, mask_score, error.
    """
    stats = mask_stats(F.coalesce("mask", F.array().cast("array<boolean>")), F.col("width"), F.col("width"), F.col("height"))
    rows = rows.withColumn("s", stats)
    ratio, area = F.col("s.area_ratio"), F.col("s.area_pixels")
    on = F.lit(True) if configured is None else configured
    status = (
        F.when(~on, "not_configured")
        .when(F.col("proposal_count") <= 0, "no_region_proposal")
        .when(F.col("error").isNotNull(), "error")
        .when(ratio > 0.85, "overlarge_mask_rejected")
        .when(area > 0, "box_prompt_refinement")
        .otherwise("invalid_mask")
    )
    return rows.select(
        "image_id", status.alias("status"), (status == "box_prompt_refinement").alias("mask_valid"), area.alias("area_pixels"), "mask_score"
    )

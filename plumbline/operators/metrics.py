"""Accuracy, balanced accuracy, ranking metrics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import ratio_or_zero
from plumbline.operators.ranks import running_totals


def category_summary(results: DataFrame, keys=("dataset", "category")) -> DataFrame:
    """Totals and accuracies per category; ``results`` has label and correct."""
    normal, anomaly = F.col("label") == 0, F.col("label") == 1
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(normal).alias("normal_total"),
        F.count_if(anomaly).alias("anomaly_total"),
        F.count_if("correct").alias("correct"),
        F.count_if(normal & F.col("correct")).alias("_nc"),
        F.count_if(anomaly & F.col("correct")).alias("_ac"),
    )
    return out.select(
        *keys,
        "total",
        "normal_total",
        "anomaly_total",
        "correct",
        ratio_or_zero(F.col("correct"), F.col("total")).alias("accuracy"),
        ratio_or_zero(F.col("_nc"), F.col("normal_total")).alias("normal_accuracy"),
        ratio_or_zero(F.col("_ac"), F.col("anomaly_total")).alias("anomaly_accuracy"),
    )


def dataset_summary(categories: DataFrame) -> DataFrame:
    return categories.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("category_count"),
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        ratio_or_zero(F.sum("correct"), F.sum("total")).alias("accuracy"),
    )


def pipeline_summary(datasets: DataFrame) -> DataFrame:
    """Micro accuracy over all rows and macro mean over datasets; null when a part lacks accuracy."""
    complete = F.every(F.col("accuracy").isNotNull())
    total, correct = F.sum("total"), F.sum("correct")
    return datasets.agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.sum("category_count").alias("category_count"),
        F.coalesce(total, F.lit(0)).alias("total"),
        F.coalesce(correct, F.lit(0)).alias("correct"),
        F.when(complete, F.try_divide(correct, total)).alias("accuracy"),
        F.when(complete, F.avg("accuracy")).alias("macro_dataset_accuracy"),
    )


def discovery_summary(samples: DataFrame, keys=("dataset", "category")) -> DataFrame:
    """Counts per category over the union of train and test categories."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    counts = samples.groupBy(*keys).agg(
        F.count_if(train).alias("train_normal"),
        F.count_if(test).alias("test_total"),
        F.count_if(test & (F.col("label") == 0)).alias("test_normal"),
        F.count_if(test & (F.col("label") == 1)).alias("test_anomaly"),
    )
    # distinct first, so what is gathered per category is its vocabulary and not its rows
    kinds = (
        samples.where(test)
        .select(*keys, "defect_type")
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("defect_type")).alias("defect_types"))
    )
    return counts.join(kinds, list(keys), "left").withColumn(
        "defect_types", F.coalesce("defect_types", F.array().cast("array<string>"))
    )


def balanced_accuracy(normal_correct: Column, normal_total: Column, abnormal_correct: Column, abnormal_total: Column):
    normal = ratio_or_zero(normal_correct, normal_total)
    abnormal = ratio_or_zero(abnormal_correct, abnormal_total)
    return (
        F.when((normal_total > 0) & (abnormal_total > 0), (normal + abnormal) / 2.0)
        .when(normal_total > 0, normal)
        .otherwise(abnormal)
    )


def answer_counts(results: DataFrame, keys=("subclass", "task_type")) -> DataFrame:
    """``results`` has correct and is_normal."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("correct").alias("correct"),
        F.count_if("is_normal").alias("normal_total"),
        F.count_if(F.col("is_normal") & F.col("correct")).alias("normal_correct"),
        F.count_if(~F.col("is_normal")).alias("abnormal_total"),
        F.count_if(~F.col("is_normal") & F.col("correct")).alias("abnormal_correct"),
        F.count_if(~F.col("correct")).alias("wrong_count"),
    )


def answer_accuracy(counts: DataFrame) -> DataFrame:
    balanced = balanced_accuracy(*[F.col(c) for c in ("normal_correct", "normal_total", "abnormal_correct", "abnormal_total")])
    percent = {
        "accuracy": ratio_or_zero(F.col("correct"), F.col("total")) * 100,
        "balanced_accuracy": balanced * 100,
        "normal_accuracy": ratio_or_zero(F.col("normal_correct"), F.col("normal_total")) * 100,
        "abnormal_accuracy": ratio_or_zero(F.col("abnormal_correct"), F.col("abnormal_total")) * 100,
    }
    return counts.withColumns(percent)


def answer_rollup(counts: DataFrame) -> DataFrame:
    """Category, task and grand totals with the mean balanced accuracy of each task over categories."""
    rows = answer_accuracy(counts).select("subclass", "task_type", "total", "correct", "balanced_accuracy")
    return (
        rows.groupingSets(
            [["subclass", "task_type"], ["subclass"], ["task_type"], []], "subclass", "task_type"
        )
        .agg(
            F.sum("total").alias("total"),
            F.sum("correct").alias("correct"),
            F.avg("balanced_accuracy").alias("mean_balanced_accuracy"),
            F.grouping_id().alias("level"),
        )
        .withColumn("accuracy", ratio_or_zero(F.col("correct"), F.col("total")) * 100)
    )


def ranking_curve(rows: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score with running counts, in score order."""
    positive = (F.col(label) != 0).cast("long")
    return running_totals(rows, keys, score, {"pos": positive, "neg": 1 - positive})


def auroc(rows: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve; ties count one half. Null when a class is absent."""
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0)
    return (
        ranking_curve(rows, keys, score, label)
        .groupBy(*keys)
        .agg(F.try_divide(F.sum(won), F.max(F.col("pos_all").cast("double") * F.col("neg_all"))).alias("auroc"))
    )


def average_precision(rows: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    hits = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    shown = hits + F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    return (
        ranking_curve(rows, keys, score, label)
        .groupBy(*keys)
        .agg(F.try_divide(F.sum(F.col("pos") * hits / shown), F.max("pos_all")).alias("average_precision"))
    )

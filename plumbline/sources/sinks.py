"""Writers and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import task_file_name


def write_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def write_documents(docs: DataFrame, path: str, folders: list[str]) -> None:
    """One file per document: ``docs`` has the folder columns and ``text`` (a document on one line)."""
    docs.select(*folders, "text").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy(*folders).text(path)


def question_documents(images: DataFrame, per_document: int = 1 << 20) -> DataFrame:
    """Question documents {key: item} (subclass, text) of about ``per_document`` characters, or one image if that is longer.

    ``images``: subclass, key, item; a key occurs once. The images of a subclass are dealt over its documents by the hash of their keys, so that
    the number of files follows the amount of text and no task holds a subclass.
    """
    sizes = images.groupBy("subclass").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length(F.to_json("item"))) / per_document)).alias("_n"))
    rows = images.join(sizes, "subclass").withColumn("_chunk", F.pmod(F.xxhash64("key"), F.col("_n")))
    grouped = rows.groupBy("subclass", "_chunk").agg(F.map_from_entries(F.collect_list(F.struct("key", "item"))).alias("items"))
    return grouped.select("subclass", F.to_json("items").alias("text"))


def metadata_documents(items: DataFrame, per_document: int = 10_000) -> DataFrame:
    """Split metadata {split: {category: [items]}} as documents (category, text) of about ``per_document`` items at most.

    ``items``: split, category, img_path and further item fields. A large category is divided by the hash of the path, so that no task holds all of it;
    ``documents.metadata_samples`` reads the documents of a dataset together.
    """
    fields = [c for c in items.columns if c not in ("split", "category")]
    sizes = items.groupBy("split", "category").agg(F.ceil(F.count(F.lit(1)) / per_document).alias("_n"))
    rows = items.join(sizes, ["split", "category"]).withColumn("_chunk", F.pmod(F.xxhash64("img_path"), F.col("_n")))
    grouped = rows.groupBy("split", "category", "_chunk").agg(F.collect_list(F.struct(F.col("category").alias("cls_name"), *fields)).alias("items"))
    return grouped.select("category", F.to_json(F.create_map("split", F.create_map("category", "items"))).alias("text"))


def wrong_answers(results: DataFrame) -> DataFrame:
    return results.where(~F.col("correct")).withColumn("task", task_file_name(F.col("task_type")))


def write_wrong_answers(results: DataFrame, path: str) -> None:
    """One folder per subclass and task; rows are spread over tasks so no folder is written by one task only."""
    wrong_answers(results).write.mode("overwrite").partitionBy("subclass", "task").json(path)


def missing_results(samples: DataFrame, results: DataFrame, key) -> DataFrame:
    return samples.join(results, key, "left_anti")


def assert_complete(samples: DataFrame, results: DataFrame) -> None:
    expected, found = samples.count(), results.count()
    if expected != found:
        raise RuntimeError(f"incomplete results: expected {expected} rows, found {found}")

"""Structured Streaming jobs over the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.documents import last_per_image


def read_rows(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def decided(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Threshold decision on arriving scores (stream joined to the static calibration)."""
    known = thresholds.select("dataset", "category", "threshold")
    return scores.join(known, ["dataset", "category"]).withColumns(
        {
            "prediction": (F.col("score") > F.col("threshold")).cast("int"),
            "correct": (F.col("score") > F.col("threshold")).cast("int") == F.col("label"),
        }
    )


#: Keyed state on local disk with its changes in the checkpoint, so that it may outgrow memory and survives lost executors.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Versions that are merged into one.
FAN = 8


def append_unseen(
    rows: DataFrame, path: str, checkpoint: str, history: DataFrame | None = None, key: str = "image_path", event_time: str | None = None, expiry: str = "30 days"
) -> StreamingQuery:
    """Each image once; images of the static history and of earlier batches are skipped.

    What was seen is keyed state, so a batch looks up its own images only, however many were seen before. With ``event_time`` an image is
    forgotten ``expiry`` after it came, and state is bounded. A table that another checkpoint's query wrote is refused, as its batches would be taken for this one's.
    """
    spark = rows.sparkSession
    if _exists(spark, f"{path}/_spark_metadata") and not _exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{path} was written by a query with another checkpoint")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if history is not None:
        rows = rows.join(history.select(key), key, "left_anti")
    rows = rows.dropDuplicates([key]) if event_time is None else rows.withWatermark(event_time, expiry).dropDuplicatesWithinWatermark([key])
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished predictions; a restart with the same checkpoint goes on where it stopped."""
    return (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _span(batch_id: int) -> int:
    """How many batches the version of a batch holds: the highest power of ``FAN`` that divides its place."""
    place, span = batch_id + 1, 1
    while place % FAN == 0:
        place, span = place // FAN, span * FAN
    return span


def _finished(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """Finished versions by batch, without those that a later one holds."""
    out: dict[int, str] = {}
    held = None
    for name in reversed(_names(spark, path)):
        batch = int(name.split("=")[1]) if name.startswith("version=") else -1
        if batch < 0 or (before is not None and batch >= before) or (held is not None and batch > held):
            continue
        if "_SUCCESS" in _names(spark, f"{path}/{name}"):
            out[batch] = f"{path}/{name}"
            held = batch - _span(batch)
    return out


def upsert_latest(rows: DataFrame, path: str, checkpoint: str, key: str = "image_path") -> StreamingQuery:
    """Keep the last row per image by ordinal; ``latest_rows`` reads them.

    A batch writes its own last rows as a version. Every ``FAN``-th batch also takes in the versions since the last such batch, every ``FAN`` squared-th those
    larger ones, and so on: a row is written again only once per level, whatever the table's size, and a reader merges few versions. A repeated
    batch writes its version anew from the same ones; versions that were held by a later one before a batch began are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _finished(spark, path, before=batch_id)
        taken = [p for b, p in before.items() if b > batch_id - _span(batch_id)]
        merged = batch.unionByName(spark.read.schema(batch.schema).parquet(*taken)) if taken else batch
        last_per_image(merged, key).write.mode("overwrite").parquet(f"{path}/version={batch_id:010d}")
        for name in _names(spark, path):
            if name.startswith("version=") and int(name.split("=")[1]) < batch_id and f"{path}/{name}" not in before.values():
                fs, folder = _folder(spark, f"{path}/{name}")
                fs.delete(folder, True)

    return (
        rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_rows(spark: SparkSession, path: str, key: str = "image_path") -> DataFrame | None:
    """The last row per image of a table that ``upsert_latest`` writes."""
    paths = sorted(_finished(spark, path).values())
    return last_per_image(spark.read.parquet(*paths), key) if paths else None


def write_versions(rows: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write the whole result of each batch as a new version; only the newest and the one before it are kept."""

    def write(batch: DataFrame, batch_id: int) -> None:
        before = newest(batch.sparkSession, path, before=batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id:010d}")
        for name in _names(batch.sparkSession, path):
            if name.startswith("version=") and int(name.split("=")[1]) < batch_id and f"{path}/{name}" != before:
                fs, folder = _folder(batch.sparkSession, f"{path}/{name}")
                fs.delete(folder, True)

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """Path of the newest finished version."""
    for name in reversed(_names(spark, path)):
        if name.startswith("version=") and (before is None or int(name.split("=")[1]) < before) and "_SUCCESS" in _names(spark, f"{path}/{name}"):
            return f"{path}/{name}"
    return None


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    found = newest(spark, path)
    return spark.read.parquet(found) if found else None


def running_accuracy(rows: DataFrame, keys=("subclass", "task_type")) -> DataFrame:
    """Totals and accuracy so far (complete or update mode)."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("correct").alias("correct"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )

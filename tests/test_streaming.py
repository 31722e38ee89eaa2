import uuid

from plumbline.session import ensure_checkpoint_dir
from plumbline.sources import sinks
from plumbline.streaming import jobs

SCHEMA = "image_path string, ordinal long, score double"


def place(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def test_restart_appends_only_new_rows_and_last_write_wins(spark):
    source, log, state, latest, state2 = (place(spark) for _ in range(5))
    first = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.2)], SCHEMA)
    first.write.parquet(source)
    for round_ in range(3):
        rows = jobs.read_rows(spark, source, SCHEMA)
        jobs.append_log(rows, log, state).awaitTermination()
        jobs.upsert_latest(rows, latest, state2).awaitTermination()
        if round_ == 0:
            spark.createDataFrame([("a", 3, 0.9)], SCHEMA).write.mode("append").parquet(source)
    assert spark.read.schema(SCHEMA).json(log).count() == 3
    got = {r["image_path"]: r["score"] for r in jobs.latest_rows(spark, latest).collect()}
    assert got == {"a": 0.9, "b": 0.2}


def test_several_batches(spark):
    """Seen images, replaced rows and totals over three batches that arrive one after another."""
    source, seen, state, latest, state2, totals, state3 = (place(spark) for _ in range(7))
    batches = [[("a", 1, 0.1), ("b", 2, 0.2), ("a", 3, 0.3)], [("b", 4, 0.4), ("c", 5, 0.5)], [("a", 6, 0.6)]]
    history = spark.createDataFrame([("c",)], "image_path string")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(source)
        rows = jobs.read_rows(spark, source, SCHEMA)
        jobs.append_unseen(rows, seen, state, history).awaitTermination()
        jobs.upsert_latest(rows, latest, state2).awaitTermination()
        counted = rows.groupBy("image_path").count()
        jobs.write_versions(counted, totals, state3).awaitTermination()
    assert sorted(r["image_path"] for r in spark.read.parquet(seen).collect()) == ["a", "b"]
    assert {r["image_path"]: r["score"] for r in jobs.latest_rows(spark, latest).collect()} == {"a": 0.6, "b": 0.4, "c": 0.5}
    assert {r["image_path"]: r["count"] for r in jobs.latest_version(spark, totals).collect()} == {"a": 3, "b": 2, "c": 1}


def test_versions_are_merged_by_levels(spark, monkeypatch):
    """Nine batches with three to a level: few versions stay, and the rows are the last ones."""
    monkeypatch.setattr(jobs, "FAN", 3)
    source, latest, state = (place(spark) for _ in range(3))
    for b in range(9):
        spark.createDataFrame([("a", b, float(b)), (f"k{b}", b, 1.0), ("old", -b, float(-b))], SCHEMA).write.mode("append").parquet(source)
        jobs.upsert_latest(jobs.read_rows(spark, source, SCHEMA), latest, state).awaitTermination()
        assert len(jobs._finished(spark, latest)) <= 4
        got = {r["image_path"]: r["ordinal"] for r in jobs.latest_rows(spark, latest).collect()}
        assert got == {"a": b, "old": 0, **{f"k{i}": i for i in range(b + 1)}}
    assert list(jobs._finished(spark, latest)) == [8]


def test_output_of_another_query_is_refused(spark):
    source, seen = place(spark), place(spark)
    spark.createDataFrame([("a", 1, 0.1)], SCHEMA).write.parquet(source)
    jobs.append_unseen(jobs.read_rows(spark, source, SCHEMA), seen, place(spark)).awaitTermination()
    try:
        jobs.append_unseen(jobs.read_rows(spark, source, SCHEMA), seen, place(spark))
    except ValueError:
        assert spark.read.parquet(seen).count() == 1
        return
    raise AssertionError("a second query wrote to the same table")


def test_seen_images_expire(spark):
    source, seen, state = (place(spark) for _ in range(3))
    schema = "image_path string, at timestamp"
    for day in (1, 2, 20, 21):
        spark.sql(f"SELECT 'a' AS image_path, timestamp'2024-01-{day:02d} 00:00:00' AS at").write.mode("append").parquet(source)
        jobs.append_unseen(jobs.read_rows(spark, source, schema), seen, state, event_time="at", expiry="5 days").awaitTermination()
    # the batch of the 20th moves the watermark past the first image; it is forgotten for the batch after
    assert sorted(r["at"].day for r in spark.read.parquet(seen).collect()) == [1, 21]


def test_completeness(spark):
    rows = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.2)], SCHEMA)
    sinks.assert_complete(rows, rows)
    assert sinks.missing_results(rows, rows.where("ordinal = 1"), "image_path").first()["image_path"] == "b"
    try:
        sinks.assert_complete(rows, rows.limit(1))
    except RuntimeError:
        return
    raise AssertionError("incomplete results were accepted")

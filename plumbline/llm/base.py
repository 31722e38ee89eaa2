"""Shared helpers: reliable storage of intermediate tables, Arrow batches cut by bytes, hot-key-safe components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import ensure_checkpoint_dir

#: Bytes of text that a task's function works on at once.
PIECE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, lineage cut, no executor needed to keep it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go when it ends, not when the driver happens to collect its garbage.

    For work whose results are kept: a query that ran inside and runs again computes its shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a text column holds about ``limit`` bytes; one longer text is a batch of its own."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for at, size in enumerate(lengths.tolist()):
            if at > start and held + size > limit:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def with_rest(batch: pa.RecordBatch, keep_columns: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in keep_columns] + list(new.values()), names=keep_columns + list(new)
    )


#: A key with more than a thousandth of all rows is hot; there are fewer than a thousand of them, whatever the table.
HOT_SHARE = 1000


def attach_by_size(rows: DataFrame, groups: DataFrame, key: list[str], size: str, one_of: tuple[str, str] | None = None) -> DataFrame:
    """Left join of ``rows`` with ``groups``, which has one row per ``key`` and the number of the key's rows as ``size``. A null matches nothing.

    Groups with more than a thousandth of the rows counted in ``groups`` (fewer than a thousand, so of bounded size) are broadcast, and what they
    match is dealt out by chance afterwards. Every other key has few rows, so an ordinary join by key has no hot task.

    ``one_of`` = (a, b) adds ``first``: true for exactly one of a matched key's rows in which a equals b (null equals null), else false.
    """
    groups = keep(groups)
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    rest = [c for c in groups.columns if c not in key]
    hot = groups.where(F.col(size) * HOT_SHARE > total).select(*(F.col(c).alias(f"__hot_{c}") for c in groups.columns))
    cold = groups.where(F.col(size) * HOT_SHARE <= total).select(*(F.col(c).alias(f"__cold_{c}") for c in groups.columns), F.lit(0).cast("long").alias("__cold"))
    found = rows.join(F.broadcast(hot), [F.col(c) == F.col(f"__hot_{c}") for c in key], "left")
    # 0 looks on among the other groups; 1 may be the first of a hot group, so these meet; all else is spread
    spread = F.pmod(F.xxhash64(*(rows.columns if one_of is None else one_of[:1])), F.lit(1 << 40)) + 2
    salt = F.when(F.col(f"__hot_{size}").isNull(), F.lit(0).cast("long"))
    if one_of:
        salt = salt.when(F.col(one_of[0]).eqNullSafe(F.col(f"__hot_{one_of[1]}")), F.lit(1).cast("long"))
    found = found.withColumn("__salt", salt.otherwise(spread))
    found = found.join(cold, [F.col(c) == F.col(f"__cold_{c}") for c in key] + [F.col("__salt") == F.col("__cold")], "left")
    found = found.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in rest), "__salt")
    if one_of:
        equal = F.col(one_of[0]).eqNullSafe(F.col(one_of[1])) & F.col(size).isNotNull()
        found = found.withColumn("first", equal & (F.row_number().over(Window.partitionBy(*key, "__salt").orderBy(equal.desc())) == 1))
    return found.drop("__salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected long edges: rows (node, root), root the smallest node of the component.

    Alternates the two star steps: each node first sends its larger neighbours to the smallest node
    around it, then its smaller ones. A hub's edges shrink by half its depth every round, so the number of rounds is logarithmic,
    and each round only aggregates and joins on node ids. Every round's edges are written to the shared folder.
    Null ends and loops are ignored; no edges give no rows.
    """
    now = keep(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        down = keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        step = keep(
            small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        )
        # a star forest: each node has one smaller neighbour, and that one has none
        if step.groupBy("u").count().where("count > 1").isEmpty() and step.join(step.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            now = step
            break
        now = step
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

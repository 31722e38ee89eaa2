"""Exact duplicates with skew-safe combining; DataFrame functions only.

Equal texts are found by grouping on a digest together with the full content, in three steps of decreasing size:

1. each task first combines the equal texts it reads itself (the partial step of the first aggregate),
2. these meet in salted groups (salt, digest, content): a text that fills a third of the table is spread over ``salts`` groups,
3. the winners of the salts, at most ``salts`` rows a text, meet in groups (digest, content).

Content takes part in every comparison, so texts whose digests collide stay apart. The rows then look up their group by digest
alone, as a digest that has one content stands for it; rows of colliding digests, if there are any, look it up by content too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import attach_by_size, keep

SALTS = 32
#: Runs of white space that count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Groups (``digest``, ``content``, ``keep_id``, ``size``) of rows (``digest``, ``content``, ``id``): smallest id (nulls aside) and number of rows."""
    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("salt", "digest", "content").agg(F.min("id").alias("keep_id"), F.count("*").alias("size"))
    return salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("size"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id`` (smallest id among equal texts), ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after each run of white space became one space. Null counts as empty, and empty texts are equal.
    Exactly one row of a group is kept: of rows that repeat with the smallest id, one. Null ids are larger than any other; a group of them
    alone has a null ``keep_id``. Texts of any length are compared whole. Other columns are not read, whatever their names; an empty table
    gives no rows. ``digest`` makes the grouping key from the content; any function will do, as contents are compared.
    """
    content = normalised(text)
    rows = docs.select(F.col(id_column).alias("id"), content.alias("content")).withColumn("digest", digest(F.col("content")))
    groups = combine(rows, salts)
    short = keep(groups.select("digest", "keep_id", "size"))
    clashes = short.groupBy("digest").count().where("count > 1").select("digest")
    named = [F.col("id").alias(id_column), "keep_id", "group_size", "kept", "text_sha256"]
    if clashes.isEmpty():
        return _looked_up(rows.select("id", "digest", _shown(digest)), short, ["digest"]).select(*named)
    clashes = keep(clashes)
    alone = _looked_up(rows.join(clashes, "digest", "left_anti").select("id", "digest", _shown(digest)), short.join(clashes, "digest", "left_anti"), ["digest"])
    shared = rows.join(clashes, "digest", "left_semi").select("id", "digest", "content", _shown(digest))
    shared = _looked_up(shared, keep(groups.join(clashes, "digest", "left_semi")), ["digest", "content"])
    return alone.unionByName(shared).select(*named)


def _shown(digest) -> Column:
    whole = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("content", 256)
    return whole.alias("text_sha256")


def _looked_up(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    found = attach_by_size(rows, groups.where("size > 1"), key, "size", one_of=("id", "keep_id"))
    return found.select(
        "id",
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | F.col("first")).alias("kept"),
        "text_sha256",
    )

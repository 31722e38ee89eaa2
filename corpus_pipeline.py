"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

1. Quality rules: rows that the base rules or the repetition rules reject go.
2. Near duplicates (five-word shingles, similarity of 0.8 or more): one row of each group stays.
3. Suffix-array dedup: byte strings of 250 bytes that begin more than once are cut out of the texts; a row whose text had words and
   has none left goes. ``n_chars`` follows the text.
4. Benchmark decontamination: rows with a contaminated pair go.
5. BPE: what is left is encoded and decoded again.

All stages but the last return the columns of ``documents``, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, repetition, shingle_join, suffix_dedup
from plumbline.llm.base import keep
from plumbline.llm.queries import vocabulary_path

#: SQL cannot express these stages together; the tests compare each with a brute-force version.
ORACLE_SQL = None
#: The workers of the last stage stay for later runs, so they remember less than those of the operator alone.
KNOWN_PARTS = 100_000
#: A passage of fifty words often has fewer bytes than the 400 that the operator alone asks for.
REPEAT_BYTES, ANCHOR_BYTES = 250, 100
#: Rows go, so a pair needs some words in common, and one slot that differs does not clear it.
DECONTAMINATION = decontaminate.TemplateSettings(template_words=8, min_consistent=0.75)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = repetition.repetition(docs, keep_columns=tuple(docs.columns), prefix="__")
    return judged.where("__kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, keep_columns=tuple(docs.columns), size=REPEAT_BYTES, anchor=ANCHOR_BYTES, prefix="__")
    changed = F.col("__n_removed") > 0
    cut = cut.where(~changed | F.col("__kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.when(changed, F.col("__kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), DECONTAMINATION)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, vocabulary_path(), known_parts=KNOWN_PARTS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontaminated),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

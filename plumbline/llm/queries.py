"""One registered query per operator, each over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, exact_dedup, html_consensus, language, prefix_counts, repetition, shingle_join, sql, suffix_dedup, token_alignment, toxicity, vector_codes, warc

QUERIES = {}
SQL: dict[str, str] = dict(sql.SQL)
#: The vocabulary the contracts name.
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 512


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_bpe_round_trip(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary_path())


@query
def op5_token_counts(spark, folder):
    return prefix_counts.token_budget(table(spark, folder, "documents"), vocabulary_path(), TOKEN_LIMIT)


@query
def op4_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True)).alias("held_out"))
    learn = docs.where((F.col("held_out") == F.lit(False)) & F.col("lang").isNotNull())
    model = language.train(learn)
    found = language.identify(docs, model, keep_columns=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", F.col("nearest").alias("lang_pred"), "score", "margin", (F.col("language") == "und").alias("rejected"))


@query
def op6_quality_rules(spark, folder):
    return repetition.repetition(table(spark, folder, "documents"))


@query
def op8_warc(spark, folder):
    records = warc.through_archives(table(spark, folder, "pages"))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


@query
def op9_html_extraction(spark, folder):
    return html_consensus.main_text(table(spark, folder, "pages"))


@query
def op7_toxicity(spark, folder):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True)).alias("held_out")
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out)
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.where(F.col("held_out") == F.lit(False)), labels=labels)
    scored = toxicity.score(docs, model, keep_columns=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op10_suffix_dedup(spark, folder):
    # what is left follows the digests, as the contract's own columns do not show which passages went
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).withColumnRenamed("kept_text", "text")


@query
def op1_ngram_jaccard(spark, folder):
    return shingle_join.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op3_benchmark_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query
def op12_vector_codes(spark, folder):
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query
def op13_token_alignment(spark, folder):
    return token_alignment.alignment(table(spark, folder, "documents"), vocabulary_path(), vocabulary_path(PIECES))

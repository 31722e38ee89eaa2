"""Column functions over model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that name a class, and keyword patterns counted in prose.
NORMAL_WORDS = ["normal", "good", "ok", "negative", "nondefective", "non defective", "no defect"]
ANOMALY_WORDS = ["anomaly", "abnormal", "defect", "defective", "positive", "bad", "damaged"]
ANOMALY_KEYWORDS = r"(?U)\b(anomaly|abnormal|defect|defective|damaged|scratch|stain)\b"
NORMAL_KEYWORDS = r"(?U)\b(normal|good|nondefective|non-defective|no defect)\b"
EVIDENCE_CHARS = 1000


def answer_letter(response: Column, mode: str = "batch") -> Column:
    """Letter after the answer phrase, else the last standalone A-D, else "A" (batch) or "" (viewer).

    The viewer also accepts the phrase in any case.
    """
    if mode not in ("batch", "viewer"):
        raise ValueError(mode)
    phrase = r"The correct answer is \(?([A-D])\)?" if mode == "batch" else r"(?i)The correct answer is\s*\(?([A-D])\)?"
    stated = F.upper(F.nullif(F.regexp_extract(response, phrase, 1), F.lit("")))
    letters = F.regexp_extract_all(response, F.lit(r"(?U)\b([A-D])\b"), 1)
    return F.coalesce(stated, F.try_element_at(letters, F.lit(-1)), F.lit("A" if mode == "batch" else ""))


def prediction_word(value: Column) -> Column:
    """"normal" / "anomaly" for a class word or a text that contains one, else null."""
    text = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[^a-z0-9_-]+", " "))
    return (
        F.when(text.isin(NORMAL_WORDS), "normal")
        .when(text.isin(ANOMALY_WORDS), "anomaly")
        .when(text.contains("anomal") | text.contains("defect") | text.contains("abnormal"), "anomaly")
        .when(text.contains("normal") | text.contains("good"), "normal")
    )


def keyword_prediction(text: Column) -> Column:
    lowered = F.lower(text)
    anomaly, normal = F.regexp_count(lowered, F.lit(ANOMALY_KEYWORDS)), F.regexp_count(lowered, F.lit(NORMAL_KEYWORDS))
    return F.when(anomaly > normal, "anomaly").when(normal > anomaly, "normal")


def parse_verifier(
    rows: DataFrame, raw: str, fallback: str, *, fallback_to_threshold: bool = True, evidence_chars: int | None = EVIDENCE_CHARS
) -> DataFrame:
    """Add parse_status, prediction_text, prediction, confidence, evidence from a raw response.

    The object is the first of: fenced JSON, the span from the first to the last brace, the
    whole text. An object without a usable class goes to the fallback; only texts without
    an object are searched for keywords. ``evidence_chars`` shortens the evidence; None keeps it whole.
    """
    text = F.trim(F.coalesce(F.col(raw), F.lit("")))
    fenced = F.nullif(F.regexp_extract("_text", r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    span = F.nullif(F.regexp_extract("_text", r"(?s)(\{.*\})", 1), F.lit(""))
    found = rows.withColumn("_text", text).withColumns(
        {"_v1": F.try_parse_json(fenced), "_v2": F.try_parse_json(span), "_v3": F.try_parse_json("_text")}
    )

    def is_object(name: str) -> Column:
        return F.startswith(F.schema_of_variant(name), F.lit("OBJECT"))

    found = found.withColumn(
        "_o", F.coalesce(*[F.when(is_object(v), F.col(v)) for v in ("_v1", "_v2", "_v3")])
    )
    names = ("prediction", "label", "answer", "evidence", "rationale", "confidence")
    found = found.withColumns({f"_{n}": F.try_variant_get("_o", f"$.{n}", "string") for n in names})

    def field(*options: str) -> Column:
        return F.coalesce(*[F.when(~F.col(f"_{n}").isin("", "false", "0"), F.col(f"_{n}")) for n in options])

    has_object = F.col("_o").isNotNull()
    found = found.withColumn(
        "_word",
        F.when(has_object, prediction_word(field("prediction", "label", "answer"))).otherwise(
            keyword_prediction(F.col("_text"))
        ),
    )
    confidence = F.col("_confidence").try_cast("double")
    if fallback_to_threshold:
        default_word, default_status = F.when(F.col(fallback) != 0, "anomaly").otherwise("normal"), "fallback_threshold"
    else:
        default_word, default_status = F.lit("unknown"), "unparsed"
    word = F.col("_word")
    stated = F.coalesce(field("evidence", "rationale"), F.lit(""))
    return found.select(
        *rows.columns,
        F.when(word.isNull(), default_status).when(has_object, "json").otherwise("keyword").alias("parse_status"),
        F.coalesce(word, default_word).alias("prediction_text"),
        F.when(word.isNull(), F.col(fallback)).otherwise((word == "anomaly").cast("int")).alias("prediction"),
        F.when(~F.isnan(confidence), confidence).alias("confidence"),
        (stated if evidence_chars is None else F.substring(stated, 1, evidence_chars)).alias("evidence"),
    )

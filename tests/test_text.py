import pytest
from pyspark.sql import functions as F

from plumbline.functions import answers, text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "token,want",
    [
        ("deformations", "deform"),
        ("deformation", "deform"),
        ("cavities", "cavy"),
        ("density", "dens"),
        ("roughness", "rough"),
        ("abrasive", "abras"),
        ("denting", "dent"),
        ("sliced", "slice"),
        ("boxes", "box"),
        ("holes", "hole"),
        ("scratches", "scratch"),
        ("cracks", "crack"),
        ("colours", "color"),
        ("removed", "remove"),
        ("gas", "gas"),
    ],
)
def test_normalized_tokens(spark, token, want):
    assert one(spark, T.normalize_token("t"), t=token) == want


@pytest.mark.parametrize(
    "report,want",
    [
        ("No visible defects, matches the normal standard", True),
        ("Normal, but a visible puncture is present", False),
        ("normal part without any crack or hole", True),
        ("not scratched and crack present; normal standard", False),
        ("a crack", False),
        ("", False),
    ],
)
def test_normal_reports(spark, report, want):
    row = spark.createDataFrame([(report,)], "r string").withColumn("n", T.normalize_text(F.col("r")))
    row = row.withColumn("w", T.ordered_tokens("n"))
    assert row.select(T.reports_normal(F.col("n"), F.col("w")).alias("r")).first()["r"] is want


def test_answer_letters(spark):
    letter = lambda text, mode="batch": one(spark, answers.answer_letter(F.col("t"), mode), t=text)
    assert letter("I say A. The correct answer is (C) or D") == "C"
    assert letter("maybe B then D") == "D"
    assert letter("none") == "A"
    assert letter("none", "viewer") == ""
    assert letter("the correct ANSWER is b", "viewer") == "B"

"""Column functions over file paths and folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and folder names with a meaning.
IMAGE_EXTENSIONS = ["bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
NORMAL_NAMES = ["good", "normal", "norm", "ok", "negative", "neg", "nondefective"]
TRAIN_NAMES = ["train", "Train", "training", "Training"]
TEST_NAMES = ["test", "Test", "testing", "Testing"]
LABEL_NAMES = ["ground_truth", "GroundTruth", "Label", "label", "labels", "Masks", "masks"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1)).isin(IMAGE_EXTENSIONS)


def folded_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def is_normal_name(name: Column) -> Column:
    return folded_name(name).isin(NORMAL_NAMES)


def is_label_name(name: Column) -> Column:
    return folded_name(name).isin(sorted({n.lower() for n in LABEL_NAMES}))


def safe_name(text: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9_.-]+", "_")
    cleaned = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", "item").otherwise(cleaned)


def task_file_name(task: Column) -> Column:
    return F.regexp_replace(task, r"[^\p{L}\p{N}_-]", "_")


def normal_by_path(path: Column) -> Column:
    parts = F.split(path, "/")
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    return F.array_contains(parts, "good") | parent.contains("good")


def name_rank(name: Column, names: list[str]) -> Column:
    """Position of a name in an ordered list, null when it is not listed."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name), F.lit(0))

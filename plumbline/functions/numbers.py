from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def general_format(value: Column) -> Column:
    """Six significant digits without trailing zeros (the usual ``%g`` text)."""
    text = F.format_string("%.6g", value)
    text = F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2")
    return F.regexp_replace(text, r"\.($|e)", "$1")


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))

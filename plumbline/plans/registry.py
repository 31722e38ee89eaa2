from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = (
    "calibration",
    "inputs",
    "filters",
    "boxes",
    "arrays",
    "vectors",
    "decisions",
    "metrics",
    "evidence",
    "graphs",
    "retrieval",
    "plugins",
)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement over the same tables."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> None:
    for module in MODULES:
        try:
            importlib.import_module(f"plumbline.plans.{module}")
        except ModuleNotFoundError as error:
            if error.name != f"plumbline.plans.{module}":
                raise

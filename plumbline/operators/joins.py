"""Join helpers. Which side is broadcast is left to adaptive execution, which knows the sizes that came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame) -> DataFrame:
    """Keep computed columns from being copied into later filters.

    The optimizer moves a filter below the projection it reads by repeating the projection's
    expressions; for long array expressions that repeats work many times over. A one-row
    generator in between lets the columns be computed once.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def attach(df: DataFrame, lookup: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join a computed table (statistics, thresholds) onto a large one, with no hint and no job while the plan is built.

    A computed table has no known size before it runs: adaptive execution broadcasts it when it turns out small, and
    splits the large side's partitions when a key is hot.
    """
    return df.join(lookup, on, how)


def meet(df: DataFrame, other: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join two tables that both grow, by shuffling both.

    What is exploded from compressed files looks far smaller to the optimizer than it is; without the hint such a side is
    broadcast before adaptive execution has seen its size, through the driver's memory.
    """
    return df.join(other.hint("merge"), on, how)


def apart(small: DataFrame, keys: list[str]) -> DataFrame:
    """Put a computed table (a row per key) behind a shuffle of its own, so that adaptive execution sees its size and can broadcast it.

    What was grouped by the keys is dealt by them already: a plain ``repartition`` by them is planned away, and the table's last steps then
    share a stage with the large side, which is sorted for the join. Dealt by their hash instead, the shuffle stays.
    """
    return small.repartition(F.xxhash64(*keys))


def look_up(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join a computed table with a row per key onto a large one whose few keys hold many rows each; only the small side is held, nothing is sorted.

    With few keys most shuffle partitions are empty, and adaptive execution then broadcasts no side.
    """
    return df.join(apart(small, keys).hint("shuffle_hash"), keys)


def literal_lookup(df: DataFrame, table: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a table written out in the code (its size is fixed by the source)."""
    return df.join(F.broadcast(table), on, how)

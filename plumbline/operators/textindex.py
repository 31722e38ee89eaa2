"""Inverted index between texts and the evidence of their category, with score bounds.

A pair can only match if it shares a strong token or an attribute, so these are the features that are posted: both sides' postings
are joined by (category, feature). A pair that shares several features meets once for each; it is kept at the first of them, so
no pair is built twice and nothing has to be grouped again. From the shared features follows an upper bound of the pair's score: weak
tokens, region words and containment add at most a fixed amount per word of the text. A pair whose bound is too low is dropped before it is
scored. Weak tokens, which nearly all texts share, are never posted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.joins import hold, meet

#: Marks a feature that is an attribute (no token contains it).
ATTRIBUTE = "#"


def strong(*tokens: str) -> Column:
    """Tokens of several columns that are not weak."""
    together = F.col(tokens[0])
    for other in tokens[1:]:
        together = F.array_union(together, F.col(other))
    return F.array_except(together, T.weak_tokens())


def attributes(*maps: str) -> Column:
    keys = F.map_keys(maps[0])
    for other in maps[1:]:
        keys = F.array_union(keys, F.map_keys(other))
    return F.transform(keys, lambda a: F.concat(F.lit(ATTRIBUTE), a))


def meeting(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows with equal ``on`` that share a feature, each once, with ``shared`` (all the features they share).

    Both sides have an array column ``features`` without repeats. A hot feature's pairs are split by adaptive execution like any skewed join.
    """
    posted = lambda df, name: df.withColumnRenamed("features", name).withColumn("_feature", F.explode(name))
    rows = meet(posted(left, "_left"), posted(right, "_right"), [*on, "_feature"])
    rows = hold(rows.withColumn("shared", F.array_intersect("_left", "_right")).drop("_left", "_right"))
    return rows.where(F.col("_feature") == F.col("shared")[0]).drop("_feature")


def split(shared: str) -> tuple[Column, Column]:
    """Of shared features, the tokens and the number of attributes."""
    tokens = F.filter(shared, lambda f: ~F.startswith(f, F.lit(ATTRIBUTE)))
    return tokens, F.size(shared) - F.size(tokens)

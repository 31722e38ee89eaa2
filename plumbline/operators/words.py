"""Texts as rows of words and tokens.

A text's words are spread over rows and normalised there, so that every rule is compiled and runs once per word; what belongs
to a text again is aggregated by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as L
from plumbline.functions import text as T
from plumbline.operators.joins import hold, meet


def _token(rows: DataFrame, word: str) -> DataFrame:
    """Add ``token``: spelling, suffix rule, spelling of a word column (dropped)."""
    rows = rows.withColumn("_s", F.expr(T.spelled(word))).drop(word)
    rows = rows.withColumn("_t", F.expr(T.stemmed("_s"))).drop("_s")
    return rows.withColumn("token", F.expr(T.spelled("_t"))).drop("_t")


def words_of(text: Column) -> Column:
    return T.raw_tokens(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" "))))


def token_rows(df: DataFrame, key: list[str], **texts: str) -> DataFrame:
    """Rows (*key, ``field``, ``token``): the tokens of each ``field=text column`` without stop words, repeated if several words give one."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.array_distinct(words_of(F.col(c))).alias("words")) for n, c in texts.items()])
    rows = df.select(*key, F.explode(fields).alias("_f")).select(*key, "_f.field", F.explode("_f.words").alias("_w"))
    stop = ", ".join(f"'{w}'" for w in L.STOP_TOKENS)
    rows = rows.where(f"length(_w) > 1 AND _w NOT IN ({stop})")
    return hold(_token(rows, "_w")).where(f"length(token) > 1 AND token NOT IN ({stop})")


def token_sets(df: DataFrame, key: list[str], **texts: str) -> DataFrame:
    """Rows (*key, ``<field>_tokens`` for each field): sorted token sets; keys without any token have no row."""
    rows = token_rows(df, key, **texts)
    return rows.groupBy(*key).agg(*[F.array_sort(F.collect_set(F.when(F.col("field") == n, F.col("token")))).alias(f"{n}_tokens") for n in texts])


def profiles(df: DataFrame, key: list[str], **texts: str) -> DataFrame:
    """``df`` with ``<field>_tokens`` and ``<field>_attrs`` of each ``field=text column``; ``key`` tells its rows apart."""
    rows = meet(df, token_sets(df, key, **texts), key, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"{n}_tokens": F.coalesce(f"{n}_tokens", none) for n in texts})
    return hold(rows.withColumns({f"{n}_attrs": T.attribute_hits(f"{n}_tokens") for n in texts}))


def affirming(df: DataFrame, key: list[str], text: Column, targets: list[str], window: int = 18, near: int = 8) -> DataFrame:
    """Keys of the texts that have a target word outside a negated span (see ``functions.text.affirms``).

    Only words that play a part - targets, negations, resets, benign words - are kept with their places, so a text of any length
    is a few rows; the words before a target are a range of places.
    """
    rows = df.select(*key, F.posexplode(T.raw_tokens(text)).alias("_at", "_w"))
    parts = sorted({*targets, *L.NEGATIONS, *L.RESETS, *L.BENIGN_HOLE_WORDS})
    rows = hold(_token(rows, "_w")).where(F.col("token").isin(parts))
    by = W.partitionBy(*key).orderBy("_at")
    before, close = by.rangeBetween(-window, -1), by.rangeBetween(-near, -1)
    last = lambda words: F.max(F.when(F.col("token").isin(words), F.col("_at"))).over(before)
    # a word that negates and resets counts as negating
    resets = [w for w in L.RESETS if w not in L.NEGATIONS]
    rows = rows.withColumns(
        {"_no": last(L.NEGATIONS), "_but": last(resets), "_benign": F.max(F.col("token").isin(L.BENIGN_HOLE_WORDS).cast("int")).over(close)}
    )
    negated = F.col("_no").isNotNull() & (F.col("_no") > F.coalesce("_but", F.lit(-1)))
    benign = (F.col("token") == "hole") & (F.coalesce("_benign", F.lit(0)) == 1)
    return rows.where(F.col("token").isin(targets) & ~negated & ~benign).select(*key).distinct()

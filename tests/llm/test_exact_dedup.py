"""Exact duplicates against a brute-force version: collisions, hot groups, repeated rows, nulls, clashing names."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Per row without ``kept``, and per group the number of kept rows is one."""
    groups = {}
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    for i, t in plain:
        groups.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain), key=str)


def check(got, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})


def make(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "\n\t ", "a b", "a  b", "a\x0bb", " a b", "a\xa0b", "A b", "long " * 20000, "long\n" * 20000]
    rows = [(rng.randint(0, 10**6), rng.choice(texts)) for _ in range(300)]
    rows += [(10**7 + k, f"one {k // 2}") for k in range(200)] + [(10**7, "one 0"), (10**7, "one 0")]
    rows += [(None, "a b"), (None, "only null"), (None, "only null"), (-5, "a b"), (-5, "a\tb")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")])
def test_brute_force(spark, digest):
    rows = make(4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(exact_dedup.exact_duplicates(docs, digest=digest).collect(), rows)


def test_nothing_hot(spark):
    rows = [(k, f"text {k % 1500}") for k in range(4000)]
    check(exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), salts=3).collect(), rows)


def test_clashing_names_and_no_rows(spark):
    names = ["id", "content", "digest", "keep_id", "size", "kept", "salt", "first", "group_size"]
    rows = [(k, f"text {k % 3}") for k in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(7).alias(n) for n in names))
    check(exact_dedup.exact_duplicates(docs).collect(), rows)
    none = exact_dedup.exact_duplicates(docs.where("doc_id < 0"))
    assert none.collect() == [] and none.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA)
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

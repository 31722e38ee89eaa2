"""Vector codes against a plain version with Python's integers; edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import vector_codes
from plumbline.llm.vector_codes import Block, CodeSettings, dictionary

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, s):
    kept = [(i, [math.floor(s.scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // s.parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(s.parts)]
    first = [cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: s.entries]]
    book = [[f[p] for f in first] for p in range(s.parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book[p]))
    for _ in range(s.rounds):
        for p in range(s.parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            new = list(book[p])
            for e, xs in groups.items():
                new[e] = [sum(c) // len(xs) for c in zip(*xs)]
            book[p] = new
    out = []
    for i, v, lab in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
    sums = {}
    for _, _, d, lab in out:
        sums[lab] = sums.get(lab, 0) + d
    digest = hashlib.sha256(",".join(str(x) for part in book for c in part for x in c).encode()).hexdigest()
    return sorted(((i, c, d, sums[lab], digest) for i, c, d, lab in out), key=str)


def make(seed, n, size, spread=1.0):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, spread) for _ in range(size)], rng.choice([None, 0, 1, 1, 1])) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * size, 1), (n + 2, [math.nan] * size, 1), (n + 3, [1.0] * (size - 1) + [-math.inf], None)]
    rows += [(3, [0.0] * size, 2), (3, [-0.5] * size, 2), (None, [0.25] * size, 2)] + [(n + 9, [0.125] * size, 3)] * 40
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,spread,n", [(16, 0.3, 300), (8, 0.0001, 100), (24, 400.0, 120), (16, 1.0, 2)])
def test_brute_force(spark, size, spread, n):
    rows, settings = make(size, n, size, spread), CodeSettings(rounds=4)
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), settings=settings).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, settings)


def test_edges(spark):
    docs = spark.createDataFrame(make(1, 60, 8), SCHEMA)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    none = vector_codes.compress(docs.where("vec_id < -1"))
    assert none.collect() == [] and none.columns == columns
    names = ["id", "code", "error", "key", "size", "length", "label_error", "vector"]
    clash = docs.select("*", *(F.lit("x").alias(c) for c in names))
    assert sorted(map(tuple, vector_codes.compress(clash).collect()), key=str) == brute(make(1, 60, 8), CodeSettings())
    # other lengths than the longest have no code; labels of any type
    rows = [(1, [0.5] * 8, "a"), (2, [0.25] * 8, None), (3, [0.5] * 7, "a"), (4, [], "a")]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"))
    assert {(r.vec_id, r.code, r.error) for r in got.collect()} == {(1, "00" * 8, 0), (2, "01" * 8, 0)}
    empty = vector_codes.compress(spark.createDataFrame([(4, [], "a"), (5, [], "a")], "vec_id long, embedding array<float>, label string")).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in empty} == {(4, "00" * 8, 0, 0), (5, "00" * 8, 0, 0)}
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], SCHEMA))


def test_dictionaries():
    rng = np.random.default_rng(1)
    for span in (5, 10**6):
        column = rng.integers(-span, span, 3000)
        values, codes = dictionary(column)
        assert (values[codes] == column).all() and (np.diff(values) > 0).all()
    whole = rng.integers(-50, 50, (700, 6))
    book = rng.integers(-50, 50, (3, 5, 2))
    best, error = Block.of(whole).assign(book)
    plain = ((whole.reshape(700, 3, 1, 2) - book[None]) ** 2).sum(axis=3)
    assert (best.T == plain.argmin(axis=2)).all() and (error.T == plain.min(axis=2)).all()

"""Nearest neighbours, class densities and prototypes over vector tables.

The memory is divided into cells around a few of its own vectors. A cell's radius bounds how close any of its vectors can come to a
query (triangle inequality on unit vectors), so a query visits only cells that can hold one of its nearest; the result is exact. Cells and queries
are cut into blocks of bounded size; a block of each meets in one task, and only the best few per query leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.arrays import let
from plumbline.operators.joins import attach

QUERY_BLOCK = 32_768
MEMORY_BLOCK = 16_384
#: Centres of the memory's cells, and how far rounding may put a distance off.
PIVOTS = 32
SLACK = 1e-6
#: Bytes of partial sums that a task holds before it passes them on.
MOMENT_BYTES = 256 << 20
#: Tasks that add up the partial sums of one class before the last one does.
SALTS = 32
#: Similarities that a task holds at once.
TILE = 4 << 20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size == 0, 1.0, size)


def _placed(matrix: np.ndarray, memory: bool) -> np.ndarray:
    """Unit vectors whose distances order like cosines. A zero vector has cosine 0 with everything, so it gets an axis of its own,
    one for those of the memory and one for those of the queries."""
    unit = _unit(matrix)
    zero = (np.linalg.norm(matrix, axis=1, keepdims=True) == 0).astype(np.float64)
    return np.hstack([unit, zero if memory else 0 * zero, 0 * zero if memory else zero])


def _away(left: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros((len(left), 0))
    return np.sqrt(np.maximum(0.0, (left**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * left @ pivots.T))


def _nearest(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of the ``k`` closest rows of ``right`` (unit rows), the lower place first among equals."""
    take = min(k, len(right))
    places, values = [], []
    step = max(1, TILE // max(1, len(right)))
    for start in range(0, len(left), step):
        near = _unit(left[start : start + step]) @ right.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :take] if take > 1 else near.argmax(axis=1)[:, None]
        places.append(order)
        values.append(np.take_along_axis(near, order, axis=1))
    return np.concatenate(places), np.concatenate(values)


def top_similar(
    queries: DataFrame,
    memory: DataFrame,
    keys: list[str],
    k: int,
    *,
    pivots: int = PIVOTS,
    query_block: int = QUERY_BLOCK,
    memory_block: int = MEMORY_BLOCK,
) -> DataFrame:
    """The ``k`` most similar memory vectors (cosine) of each query within its key group.

    ``queries``: keys, query_id, vec. ``memory``: keys, memory_id, vec (both ids are long).
    Returns keys, query_id, memory_id, similarity, rank; ties go to the lower id.

    The ``pivots`` vectors of the memory with the smallest hash of their id are the centres of the cells, whatever their keys; a vector belongs to the nearest one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    named = ", ".join(f"{c} {kinds[c]}" for c in keys)
    names = [*keys, "query_id", "memory_id", "similarity"]
    queries, memory = (df.select(*keys, name, "vec").toDF(*keys, name, "vec") for df, name in ((queries, "query_id"), (memory, "memory_id")))
    chosen = memory.select("memory_id", "vec").orderBy(F.xxhash64("memory_id"), "memory_id").limit(pivots).collect()  # bounded by their number
    centres = _placed(_matrix(pd.Series([r.vec for r in chosen])), True) if chosen else np.zeros((0, 0))

    def celled(batches):
        for pdf in batches:
            away = _away(_placed(_matrix(pdf["vec"]), True), centres)
            yield pdf.assign(_cell=away.argmin(axis=1), _d=away.min(axis=1))

    def measured(batches):
        for pdf in batches:
            yield pdf.assign(_away=list(_away(_placed(_matrix(pdf["vec"]), False), centres)))

    kind = memory.schema["vec"].dataType.simpleString()
    cells = memory.mapInPandas(celled, f"{named}, memory_id long, vec {kind}, _cell int, _d double")
    sizes = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_r"))
    # at most one entry per centre
    held = sizes.groupBy(*keys).agg(F.collect_list(F.struct("_cell", "_n", "_r")).alias("_cells"))
    asked = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / query_block).alias("_nq"))
    kind = queries.schema["vec"].dataType.simpleString()
    q = attach(queries.mapInPandas(measured, f"{named}, query_id long, vec {kind}, _away array<double>"), held.join(asked, keys), keys)
    q = q.withColumn("_cells", reachable(F.col("_cells"), F.col("_away"), k)).drop("_away").withColumn("_c", F.explode("_cells"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_c._n") / memory_block) - 1))
    q = q.select(*keys, "query_id", "vec", F.pmod(F.xxhash64("query_id"), F.col("_nq")).alias("_q"), F.col("_c._cell").alias("_cell"), block.alias("_m"))
    m = attach(attach(cells.drop("_d"), sizes.drop("_r"), [*keys, "_cell"]), asked, keys)
    m = m.withColumn("_m", F.pmod(F.xxhash64("memory_id"), F.ceil(F.col("_n") / memory_block))).withColumn(
        "_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq") - 1))
    )
    by = [*keys, "_cell", "_q", "_m"]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        right = right.sort_values("memory_id")
        order, near = _nearest(_matrix(left["vec"]), _unit(_matrix(right["vec"])), k)
        take = order.shape[1]
        out = {c: np.repeat(left[c].to_numpy(), take) for c in [*keys, "query_id"]}
        out["memory_id"] = right["memory_id"].to_numpy()[order].ravel()
        out["similarity"] = near.ravel()
        return pd.DataFrame(out)[names]

    m = m.select(*by, "memory_id", "vec").toDF(*by, "memory_id", "vec")
    found = q.select(*by, "query_id", "vec").groupBy(*by).cogroup(m.groupBy(*by))
    pairs = found.applyInPandas(score, f"{named}, query_id long, memory_id long, similarity double")
    if k == 1:
        best = F.min(F.struct((-F.col("similarity")).alias("d"), "memory_id"))
        return (
            pairs.groupBy(*keys, "query_id")
            .agg(best.alias("_b"))
            .select(*keys, "query_id", F.col("_b.memory_id").alias("memory_id"), (-F.col("_b.d")).alias("similarity"), F.lit(1).alias("rank"))
        )
    rank = F.row_number().over(W.partitionBy(*keys, "query_id").orderBy(F.desc("similarity"), "memory_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def reachable(cells: Column, away: Column, k: int) -> Column:
    """The cells that can hold one of a query's ``k`` nearest vectors.

    ``cells``: array of (_cell, _n, _r), ``away``: the query's distance to each centre. All vectors of a cell are within distance + radius; the nearest cells
    that have ``k`` vectors together bound the k-th distance, and a cell whose nearest possible vector lies beyond is left out.
    """
    bounds = F.array_sort(F.transform(cells, lambda c: F.struct((F.element_at(away, c["_cell"] + 1) + c["_r"]).alias("far"), c["_n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("far"))
    last = F.aggregate(bounds, start, lambda a, b: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + b["n"]).alias("n"), b["far"].alias("far"))))
    return let(last["far"], lambda far: F.filter(cells, lambda c: F.element_at(away, c["_cell"] + 1) - c["_r"] <= far + SLACK))


def nearest_distance(queries: DataFrame, memory: DataFrame, keys: list[str], **blocks) -> DataFrame:
    """Distance (1 - cosine) of each query to the closest memory vector, with that vector's id."""
    out = top_similar(queries, memory, keys, 1, **blocks)
    return out.select(*keys, "query_id", "memory_id", (1.0 - F.col("similarity")).alias("distance"))


def nearest_difference(queries: DataFrame, memory: DataFrame, nearest: DataFrame, keys: list[str]) -> DataFrame:
    """|query - nearest memory vector| on unit vectors."""

    def unit(vec: str) -> Column:
        size = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
        return let(size, lambda n: F.transform(vec, lambda v: v.cast("double") / n))

    return (
        nearest.join(queries.select(*keys, "query_id", unit("vec").alias("_a")), [*keys, "query_id"])
        .join(memory.select(*keys, "memory_id", unit("vec").alias("_b")), [*keys, "memory_id"])
        .withColumn("difference", F.zip_with("_a", "_b", lambda a, b: F.abs(a - b)))
        .drop("_a", "_b")
    )


def first_per_category(rows: DataFrame, k: int, key: str = "category", order: str = "vec_id") -> DataFrame:
    """Support memory: the first ``k`` rows of each category."""
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def prototypes(members: DataFrame, keys: list[str], order: str, cap: int | None = None) -> DataFrame:
    """Mean vector per key divided by its length + 1e-8; ``members`` has keys, order and vec."""
    if cap is not None:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
        members = members.withColumn("_place", place).where(F.col("_place") <= cap)
    means = (
        members.select(*keys, F.posexplode("vec").alias("dim", "v"))
        .groupBy(*keys, "dim")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
    )
    vectors = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "m")))["m"].alias("_mean"))
    size = F.sqrt(F.aggregate("_mean", F.lit(0.0), lambda a, v: a + v * v))
    return vectors.select(*keys, let(size, lambda n: F.transform("_mean", lambda v: v / (n + 1e-8))).alias("vec"))


def merged_prototype(a: Column, b: Column) -> Column:
    mid = F.zip_with(a, b, lambda x, y: (x + y) / 2.0)
    size = F.sqrt(F.aggregate(mid, F.lit(0.0), lambda s, v: s + v * v))
    return let(size, lambda n: F.transform(mid, lambda v: F.try_divide(v, n)))


def class_moments(rows: DataFrame, key: str = "category") -> DataFrame:
    """Population mean and covariance per class: key, n, i, j, mean_i, cov (for i <= j).

    Tasks emit partial sums per class, as arrays, and hold at most ``MOMENT_BYTES`` of them. The arrays of a class are added in a
    tree, first in ``SALTS`` tasks and then in one, each one after another, so no step grows with rows or classes.
    """

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for name, group in pdf.groupby(key):
                x = _matrix(group["vec"])
                got = sums.get(name)
                part = [len(x), x.sum(axis=0), x.T @ x]
                sums[name] = part if got is None else [a + b for a, b in zip(got, part, strict=True)]
                if len(sums) * part[2].nbytes > MOMENT_BYTES:
                    yield from map(packed, sums.items())
                    sums = {}
        yield from map(packed, sums.items())

    def packed(item):
        name, (n, s, p) = item
        return pd.DataFrame({key: [name], "n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    def summed(name, n, s, p):
        return packed((name, (n, s, p)))

    def added(batches, finished):
        held = None
        for pdf in batches:
            for name, n, s, p in zip(pdf[key], pdf["n"], pdf["s"], pdf["p"], strict=True):
                if held is not None and held[0] != name:
                    yield finished(*held)
                    held = None
                held = (name, n, s, p) if held is None else (name, held[1] + n, held[2] + s, held[3] + p)
        if held is not None:
            yield finished(*held)

    def moments(name, n, s, p):
        mean, d = s / n, len(s)
        i, j = np.triu_indices(d)
        cov = p.reshape(d, d)[i, j] / n - mean[i] * mean[j]
        return pd.DataFrame({key: [name] * len(i), "n": n, "i": i, "j": j, "mean_i": mean[i], "cov": cov})

    kind = rows.schema[key].dataType.simpleString()
    sums = f"{key} {kind}, n long, s array<double>, p array<double>"
    parts = rows.select(key, "vec").mapInPandas(partial, sums)
    # a tree: the partial sums of a class are first added by salt, then the salts' sums
    salted = parts.withColumn("_salt", F.spark_partition_id() % SALTS).repartition(key, "_salt").sortWithinPartitions(key, "_salt")
    half = salted.drop("_salt").mapInPandas(lambda batches: added(batches, summed), sums)
    together = half.repartition(key).sortWithinPartitions(key)
    return together.mapInPandas(lambda batches: added(batches, moments), f"{key} {kind}, n long, i int, j int, mean_i double, cov double")


def most_likely_class(
    queries: DataFrame, classes: DataFrame, *, key: str = "category", diagonal: bool = False, block: int = QUERY_BLOCK
) -> DataFrame:
    """Class with the highest Gaussian log-density per query.

    ``queries``: query_id, vec. ``classes``: one row per class with mean and covariance
    (flat, row-major; or the variances when ``diagonal``). Queries are hashed into blocks and the class rows are copied to each.
    """
    kind = classes.schema[key].dataType.simpleString()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query_id", key, "log_density"])
        right = right.sort_values(key)
        x = _matrix(left["vec"])
        logs = []
        for mean, cov in zip(right["mean"], right["covariance"]):
            away = x - np.asarray(mean, dtype=np.float64)
            spread = np.asarray(cov, dtype=np.float64)
            if diagonal:
                logs.append(-0.5 * ((away**2 / spread) + np.log(2 * np.pi * spread)).sum(axis=1))
            else:
                low = np.linalg.cholesky(spread.reshape(len(mean), len(mean)))
                solved = np.linalg.solve(low, away.T)
                constant = len(mean) * np.log(2 * np.pi) + 2 * np.log(np.diag(low)).sum()
                logs.append(-0.5 * ((solved**2).sum(axis=0) + constant))
        table = np.stack(logs, axis=1)
        best = table.argmax(axis=1)
        return pd.DataFrame(
            {"query_id": left["query_id"].to_numpy(), key: right[key].to_numpy()[best], "log_density": table[np.arange(len(best)), best]}
        )

    schema = f"query_id long, {key} {kind}, log_density double"
    n = queries.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("n"))
    blocks = F.lit(n.scalar())
    q = queries.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), blocks).cast("long").alias("_b"))
    c = classes.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    return q.groupBy("_b").cogroup(c.groupBy("_b")).applyInPandas(score, schema)

"""Exact order statistics and running totals that never gather a large group.

A sketch proposes values per group between which a wanted rank lies; rows below are counted, and only rows between are sorted.
The result is exact, since ranks come from counts and the sketch only places the cuts. The plan is the same for
inputs of every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.joins import apart, attach, look_up


def slice_of(value: Column, cuts: Column, n_cuts: int) -> Column:
    """Number of cuts strictly below ``value``, by binary search over a sorted array."""
    if n_cuts <= 8:
        total = F.lit(0)
        for i in range(n_cuts):
            total = total + F.coalesce((F.get(cuts, F.lit(i)) < value).cast("int"), F.lit(0))
        return total
    steps = []
    step = 1 << (n_cuts.bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    return F.reduce(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(cuts, at + s - 1) < value, at + s).otherwise(at),
    )


#: Marks of the sketch that brackets absolute deviations; a bracket holds about eight of them.
GRID = 4096
ACCURACY = 200_000
#: Margin of a bracket around a wanted quantile, ten times what the sketch may be off by.
WIDTH = 5e-5


def _inside(value: Column, low: str, high: str) -> Column:
    return F.when(value < F.col(low), "below").when(value <= F.col(high), "inside")


def _sketched(value: str, marks: list[float]) -> Column:
    """Approximate quantiles, with the marks as one piece of SQL text: thousands of literal columns are slow to build one by one."""
    return F.expr(f"percentile_approx({value}, array({', '.join(f'{m!r}D' for m in marks)}), {ACCURACY})")


def order_statistics(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, deviation: str | None = None, grid: int = GRID) -> DataFrame:
    """Linear-interpolated quantiles per group, the group's count and maximum, and the median of absolute deviations from its median.

    Returns ``keys, n, max_value``, a column per entry of ``probs`` and, if named, ``deviation``. Nulls do not count.

    The first pass sketches each group and derives brackets: two values between which a wanted order statistic lies. The median's bracket
    also bounds every row's deviation, and the sketch's marks bracket the deviations' median. The second pass counts the rows below
    each bracket and moves those inside, a small share of a group whatever its size; sorting them gives the exact values. Counts are checked
    against the wanted ranks, so that a bracket that missed would be an error and not a wrong result.
    """
    probs = {name: min(1.0, max(0.0, float(p))) for name, p in probs.items()}
    wanted = dict(probs)
    if deviation is not None:
        wanted["_centre"] = 0.5
    marks = [min(1.0, max(0.0, p + d)) for p in wanted.values() for d in (-WIDTH, WIDTH)]
    steps = [(i + 0.5) / grid for i in range(grid)]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        _sketched("_v", [*marks, *steps]).alias("_q"), F.count("_v").alias("n"), F.max("_v").alias("max_value")
    )
    names = {name: (f"_low{i}", f"_high{i}") for i, name in enumerate(wanted)}
    # the margin of a bracket: at least the two values around a rank, which in a small group have many marks of the grid each
    own = F.ceil(F.lit(float(grid)) / F.col("n")).cast("int")
    narrow = F.col("n") * WIDTH >= 2
    mark = lambda at: F.get("_q", F.lit(len(marks)) + F.least(F.greatest(at, F.lit(0)), F.lit(grid - 1)))
    bounds = {}
    for i, (name, p) in enumerate(wanted.items()):
        low, high = names[name]
        bounds[low] = F.when(narrow, F.get("_q", F.lit(2 * i))).otherwise(mark(F.lit(int(p * grid)) - own - 2))
        bounds[high] = F.when(narrow, F.get("_q", F.lit(2 * i + 1))).otherwise(mark(F.lit(int(p * grid)) + own + 2))
    brackets = sketch.withColumns(bounds)
    if deviation is not None:
        low, high = names["_centre"]
        middle = (F.col(low) + F.col(high)) / 2
        slack = F.col(high) - F.col(low)
        away = F.array_sort(F.transform(F.slice("_q", len(marks) + 1, grid), lambda x: F.abs(x - middle)))
        place = lambda at: F.get("_away", F.least(F.greatest(at, F.lit(0)), F.lit(grid - 1)))
        brackets = brackets.withColumn("_away", away).withColumns(
            {"_near": place(F.lit(grid // 2 - 5) - own) - slack, "_far": place(F.lit(grid // 2 + 4) + own) + slack}
        )
    # brackets go through a shuffle of their own, so that all tasks of a split group read the same ones
    brackets = brackets.select(*keys, "n", "max_value", *[c for pair in names.values() for c in pair], *(["_near", "_far"] if deviation is not None else []))
    tagged = look_up(rows, brackets, keys)
    places = {name: _inside(F.col("_v"), low, high) for name, (low, high) in names.items()}
    if deviation is not None:
        low, high = (F.col(c) for c in names["_centre"])
        most = F.greatest(F.abs(F.col("_v") - low), F.abs(F.col("_v") - high))
        least = F.greatest(F.lit(0.0), low - F.col("_v"), F.col("_v") - high)
        places["_deviation"] = F.when(most < F.col("_near"), "below").when(least <= F.col("_far"), "inside")
    kinds = F.array_compact(
        F.array(*[F.when(at.isNotNull(), F.struct(F.lit(name).alias("kind"), F.when(at == "inside", F.col("_v")).alias("at"))) for name, at in places.items()])
    )
    counted = tagged.select(*keys, "n", "max_value", F.explode(kinds).alias("_k")).groupBy(*keys, "n", "max_value", "_k.kind", "_k.at").agg(F.count(F.lit(1)).alias("_m"))
    by_key = counted.repartition(*keys)
    upto = W.partitionBy(*keys, "kind").orderBy(F.col("at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = by_key.withColumn("_upto", F.sum("_m").over(upto))
    whole = W.partitionBy(*keys)
    if deviation is not None:
        centre = _interpolated(F.col("kind") == "_centre", 0.5, F.col("at"), whole)
        ranked = ranked.withColumn("_centre", centre)
        ranked = ranked.withColumn("_d", F.when(F.col("kind") == "_deviation", F.abs(F.col("at") - F.col("_centre"))))
        beyond = W.partitionBy(*keys, "kind").orderBy(F.col("_d").asc_nulls_first(), "at").rowsBetween(W.unboundedPreceding, 0)
        ranked = ranked.withColumn("_upto", F.when(F.col("kind") == "_deviation", F.sum("_m").over(beyond)).otherwise(F.col("_upto")))
    found = [_interpolated(F.col("kind") == name, p, F.col("at"), None).alias(name) for name, p in probs.items()]
    if deviation is not None:
        found.append(_interpolated(F.col("kind") == "_deviation", 0.5, F.col("_d"), None).alias(deviation))
    out = ranked.groupBy(*keys, "n", "max_value").agg(*found)
    every = [*probs, *([deviation] if deviation is not None else [])]
    return out.withColumns({c: F.coalesce(c, F.raise_error(F.lit("a sketch's bracket missed a wanted rank")).cast("double")) for c in every})


def _interpolated(of_kind: Column, p: float, at: Column, window) -> Column:
    """The quantile of the rows of a kind from their running counts; null where the wanted ranks are not among the rows inside."""
    position = (F.col("n") - 1) * F.lit(p)

    def ranked(rank: Column) -> Column:
        here = of_kind & at.isNotNull() & (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_m"))
        value = F.max(F.when(here, at))
        return value if window is None else value.over(window)

    low, high = ranked(F.floor(position)), ranked(F.ceil(position))
    part = position - F.floor(position)
    return low + (high - low) * (part if window is not None else F.max(part))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group plus the group's count and maximum: ``keys, n, max_value`` and one column per entry of ``probs``."""
    return order_statistics(df, keys, value, probs)


#: Parts of a group whose smallest values bound the few wanted rows.
PARTS = 256


def near_smallest(df: DataFrame, keys: list[str], value: str, n: int, spread: list[str], parts: int = PARTS) -> DataFrame:
    """The rows that can be among the ``n`` with the smallest ``value`` of their group, ties included, and few others.

    A group is dealt over ``parts`` by the hash of ``spread``; the n-th smallest of the parts' minima is a bound that at least ``n`` rows keep. It takes a
    pass with one number per part, so nothing is sorted before most rows are gone. A group with values in fewer than ``n`` parts keeps all its rows.
    What is left is dealt by ``keys``, in a shuffle of its own so that the rows before it need not be.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(max(parts, 16 * n))).alias("_part")
    minima = df.groupBy(*keys, part).agg(F.min(value).alias("_least"))
    bounds = minima.groupBy(*keys).agg(F.get(F.array_sort(F.collect_list("_least")), F.lit(n - 1)).alias("_bound"))
    kept = look_up(df, bounds, keys).where(F.col("_bound").isNull() | (F.col(value) <= F.col("_bound")))
    return apart(kept.drop("_bound"), keys)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, Column],
    *,
    slices: int = 1024,
) -> DataFrame:
    """Sums per distinct value and running sums in value order, per group.

    Returns ``keys, order`` and, for each measure ``m``: ``m`` (sum at the value),
    ``m_upto`` (sum over values <= it) and ``m_all`` (group total).
    """
    names = list(measures)
    per_value = df.groupBy(*keys, order).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    marks = [i / slices for i in range(1, slices)]
    cuts = per_value.groupBy(*keys).agg(
        F.percentile_approx(order, marks, slices * 16).alias("_cuts"),
        *[F.sum(n).alias(f"{n}_all") for n in names],
    )
    tagged = attach(per_value, cuts, keys).withColumn("_slice", slice_of(F.col(order), F.col("_cuts"), len(marks)))
    tagged = tagged.drop("_cuts")
    per_slice = tagged.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names]
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = attach(tagged, offsets, [*keys, "_slice"])
    return out.select(
        *keys,
        order,
        *names,
        *[(F.col(f"_o_{n}") + F.sum(n).over(inside)).alias(f"{n}_upto") for n in names],
        *[f"{n}_all" for n in names],
    )

"""Order statistics and running totals give the plain results, hot groups included, with no join broadcast by estimate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibrate, metrics
from plumbline.operators.ranks import exact_quantiles, near_smallest, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(6000):
        key = "hot" if i % 3 else f"k{i % 7}"  # two thirds of all rows share one key
        value = float(rng.choice([0.0, 1.0, rng.normal()])) if key == "hot" else float(rng.normal())
        data.append(("s", key, f"p{i:05d}", value, int(rng.random() < 0.3)))
    return spark.createDataFrame(data, "dataset string, category string, image_path string, score double, label int").cache()


def grouped(rows):
    return {k: g for k, g in rows.toPandas().groupby("category")}


def test_exact_quantiles(large, rows):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r["category"]: r for r in exact_quantiles(rows, ["category"], "score", probs).collect()}
    for key, group in grouped(rows).items():
        assert got[key]["n"] == len(group)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(group["score"], p), abs=1e-12)


def test_calibration(large, rows):
    got = {r["category"]: r for r in calibrate.calibrate(rows).collect()}
    for key, group in grouped(rows).items():
        s = group["score"].to_numpy()
        m = np.median(s)
        mad = np.median(np.abs(s - m))
        want = max(np.quantile(s, 0.995), m + 6 * 1.4826 * mad)
        assert got[key]["threshold"] == pytest.approx(want, abs=1e-9)


def test_running_totals(large, rows):
    out = running_totals(rows, ["category"], "score", {"n": F.lit(1), "pos": F.col("label")}, slices=16).collect()
    by_key = grouped(rows)
    for r in out:
        s = by_key[r["category"]]
        assert r["n_upto"] == (s["score"] <= r["score"]).sum()
        assert r["pos_upto"] == s.loc[s["score"] <= r["score"], "label"].sum()
        assert r["n_all"] == len(s)


def test_ranking_metrics(large, rows):
    auc = {r["category"]: r["auroc"] for r in metrics.auroc(rows, ["category"]).collect()}
    ap = {r["category"]: r["average_precision"] for r in metrics.average_precision(rows, ["category"]).collect()}
    for key, group in grouped(rows).items():
        s, y = group["score"].to_numpy(), group["label"].to_numpy()
        pos, neg = s[y == 1], s[y == 0]
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert auc[key] == pytest.approx(wins / (len(pos) * len(neg)))
        want = sum(
            (y[s == t].sum() / y.sum()) * (y[s >= t].sum() / (s >= t).sum()) for t in np.unique(s)
        )
        assert ap[key] == pytest.approx(want)


def test_no_scores_is_no_row(large, spark, rows):
    assert calibrate.calibrate(rows, shots=0).count() == 0
    wanted = spark.createDataFrame([("s", "new")], "dataset string, category string")
    row = calibrate.preset_thresholds(wanted, rows, fixed=None).first()
    assert (row["n"], row["threshold"], row["threshold_policy"]) == (0, 0.5, "fixed(0.5)")


def test_computed_tables_carry_no_hint(spark):
    from plumbline.operators.joins import attach

    many = spark.range(10).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(1000))))
    plan = attach(spark.range(10), many, ["id"])._jdf.queryExecution().analyzed().toString()
    assert "Hint" not in plan


@pytest.mark.parametrize("parts", [1, 256])
def test_near_smallest_keeps_ties_and_little_else(large, rows, parts):
    away = rows.withColumn("away", F.abs(F.col("score") - 0.25))
    got = near_smallest(away, ["category"], "away", 3, ["image_path"], parts=parts).toPandas()
    for key, group in grouped(away).items():
        least = group["away"].sort_values().iloc[2]
        near = got[got["category"] == key]
        assert set(group[group["away"] <= least]["image_path"]) <= set(near["image_path"])
        assert len(near) <= len(group) and (key != "hot" or len(near) < len(group) / 10)


def test_reference_rows_are_found_without_sorting_all_rows(large, spark):
    from plumbline.plans.calibration import normal_reference_rows

    train = spark.range(4000).select(F.lit("s").alias("dataset"), F.lit("c").alias("category"), F.format_string("p%05d", "id").alias("image_path"), (F.col("id") % 1001).cast("double").alias("score"))
    picked = normal_reference_rows(train, 3)
    got = [(r.image_path, r.score, r.place) for r in picked.orderBy("place").collect()]
    middle = np.median([k % 1001 for k in range(4000)])
    want = sorted((abs(k % 1001 - middle), float(k % 1001), f"p{k:05d}") for k in range(4000))[:3]
    assert got == [(path, score, place) for place, (_, score, path) in enumerate(want, 1)]
    assert "SortMergeJoin" not in picked._jdf.queryExecution().executedPlan().toString()

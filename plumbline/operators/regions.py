"""Connected regions of heatmaps and region overlap curves.

Spark partitions the images; the helpers below work on one image's array inside a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.joins import attach


def _grid(values, height, width) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(int(height), int(width))


def _shifts(diagonal: bool):
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    return near + [(-1, -1), (-1, 1), (1, -1), (1, 1)] if diagonal else near


def label_components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Component ids 1.. in raster order of their first pixel, 0 for background.

    Every pixel takes the smallest index among its neighbours and then follows that pixel's
    own label, until nothing changes; labels travel in doubling steps.
    """
    h, w = mask.shape
    none = h * w
    label = np.where(mask.ravel(), np.arange(none), none)
    label = np.append(label, none)
    while True:
        padded = np.full((h + 2, w + 2), none, dtype=label.dtype)
        padded[1:-1, 1:-1] = label[:-1].reshape(h, w)
        low = padded[1:-1, 1:-1].copy()
        for dy, dx in _shifts(diagonal):
            np.minimum(low, padded[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx], out=low)
        new = label.copy()
        new[:-1] = np.where(mask.ravel(), low.ravel(), none)
        roots = new.copy()
        np.minimum.at(roots, label[:-1], new[:-1])
        roots = roots[roots]
        if np.array_equal(roots, label):
            break
        label = roots
    flat = label[:-1]
    out = np.zeros(none, dtype=np.int32)
    first, inverse = np.unique(flat[flat < none], return_inverse=True)
    out[flat < none] = inverse + 1 if len(first) else 0
    return out.reshape(h, w)


def component_labels(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """Add ``labels``: flat 8-connected component ids (0 is background). ``masks``: image_id, height, width."""

    def run(batches):
        for pdf in batches:
            got = [
                label_components(np.asarray(m, dtype=bool).reshape(int(h), int(w))).ravel().tolist()
                for m, h, w in zip(pdf[mask], pdf["height"], pdf["width"])
            ]
            yield pd.DataFrame({"image_id": pdf["image_id"], "labels": got})

    rows = masks.select("image_id", "height", "width", mask)
    return rows.mapInPandas(run, "image_id long, labels array<int>")


def _region_histograms(batches, key: str, steps: int):
    """Per key of the batch and score bin: recall added up over regions, and pixels outside; bin -1 has the numbers of regions and of pixels outside."""
    for pdf in batches:
        sums: dict = {}
        for name, vals, mask, h, w, lo, hi in zip(pdf[key], pdf["vals"], pdf["mask"], pdf["height"], pdf["width"], pdf["lo"], pdf["hi"], strict=True):
            v, region = np.asarray(vals, dtype=np.float64), label_components(np.asarray(mask, dtype=bool).reshape(int(h), int(w))).ravel()
            step = (hi - lo) / steps
            at = np.clip(np.ceil((v - lo) / step), 0, steps).astype(np.int64) if step > 0 else np.zeros(len(v), np.int64)
            area = np.bincount(region)
            recall, outside = sums.setdefault(name, (np.zeros(steps + 2), np.zeros(steps + 2)))
            inside = region > 0
            recall[:-1] += np.bincount(at[inside], 1.0 / area[region[inside]], steps + 1)
            outside[:-1] += np.bincount(at[~inside], minlength=steps + 1)
            recall[-1] += len(area) - 1
            outside[-1] += (~inside).sum()
        for name, (recall, outside) in sums.items():
            yield pd.DataFrame({key: [name] * (steps + 2), "bin": [*range(steps + 1), -1], "recall": recall, "false": outside.astype(np.int64)})


def region_overlap_area(maps: DataFrame, key: str = "category", steps: int = 200, limit: float = 0.3) -> DataFrame:
    """Area under the mean-region-recall curve for false-positive rates below ``limit``, rescaled to 0..1.

    ``maps``: image_id, key, height, width, vals, mask. A region lies in one image, so an image's regions are labelled and counted into ``steps`` score bins in the
    same pass, and tasks hand on one small histogram per key and batch.
    """
    bounds = maps.groupBy(key).agg(F.min(F.array_min("vals")).cast("double").alias("lo"), F.max(F.array_max("vals")).cast("double").alias("hi"))
    rows = attach(maps.select(key, "height", "width", "vals", "mask"), bounds, [key])
    kind = maps.schema[key].dataType.simpleString()
    counted = rows.mapInPandas(lambda batches: _region_histograms(batches, key, steps), f"{key} {kind}, bin int, recall double, false long")
    hist = counted.groupBy(key, "bin").agg(F.sum("recall").alias("recall"), F.sum("false").alias("false"))
    whole = W.partitionBy(key)
    of_key = lambda c: F.max(F.when(F.col("bin") == -1, F.col(c))).over(whole)
    hist = hist.withColumns({"regions": of_key("recall"), "negatives": of_key("false")}).where("bin >= 0")
    above = whole.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    # threshold number t keeps the pixels of bins above t
    curve = hist.select(
        key, (F.col("bin") - 1).alias("t"), (F.sum("recall").over(above) / F.col("regions")).alias("pro"), F.try_divide(F.sum("false").over(above), "negatives").alias("fpr")
    ).where((F.col("t") >= 0) & (F.col("fpr") < limit))
    low, high = F.min("fpr").over(whole), F.max("fpr").over(whole)
    scaled = curve.withColumn("x", F.try_divide(F.col("fpr") - low, high - low))
    nxt = whole.orderBy("t")
    piece = (F.col("x") - F.lead("x").over(nxt)) * (F.col("pro") + F.lead("pro").over(nxt)) / 2.0
    return scaled.withColumn("piece", piece).groupBy(key).agg(F.sum("piece").alias("pro_area"))

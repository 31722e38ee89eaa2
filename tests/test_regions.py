import numpy as np
import pytest

from plumbline.operators import regions as R


def flood(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not labels[a, b]:
                labels[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return labels


def test_labels_match_flood_fill():
    rng = np.random.default_rng(0)
    for size in ((1, 1), (8, 8), (40, 23)):
        for share in (0.0, 0.3, 0.5, 0.9, 1.0):
            mask = rng.random(size) < share
            assert np.array_equal(R.label_components(mask), flood(mask))


def test_overlap_area_matches_direct_computation(spark):
    rng = np.random.default_rng(2)
    rows, maps, masks = [], [], []
    for i in range(6):
        heat, mask = rng.random((8, 8)), rng.random((8, 8)) < 0.25
        heat[mask] += 0.4
        rows.append((i, "c", 8, 8, heat.ravel().tolist(), mask.ravel().tolist()))
        maps.append(heat)
        masks.append(mask)
    df = spark.createDataFrame(rows, "image_id long, category string, height int, width int, vals array<double>, mask array<boolean>")
    got = R.region_overlap_area(df).first()["pro_area"]
    maps, masks = np.array(maps), np.array(masks)
    step = (maps.max() - maps.min()) / 200
    pros, fprs = [], []
    for t in range(200):
        hot = maps > maps.min() + t * step
        part = [hot[i][lab == k].mean() for i in range(6) for lab in [flood(masks[i])] for k in range(1, lab.max() + 1)]
        pros.append(np.mean(part))
        fprs.append((hot & ~masks).sum() / (~masks).sum())
    pros, fprs = np.array(pros), np.array(fprs)
    keep = fprs < 0.3
    x = (fprs[keep] - fprs[keep].min()) / (fprs[keep].max() - fprs[keep].min())
    want = abs(np.trapezoid(pros[keep], x))
    assert got == pytest.approx(want, abs=1e-9)

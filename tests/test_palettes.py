"""Palettes of all images at once against the cuts of one image."""

import numpy as np
import pytest

from quern.operators import palettes


def plain(points, weights, most):
    """Boxes of one image, one cut after another."""
    boxes = [np.arange(len(points))]

    def error(b):
        p, w = points[b], weights[b]
        e = (p * p * w[:, None]).sum(0) - (p * w[:, None]).sum(0) ** 2 / w.sum()
        e = np.where(p.min(0) < p.max(0), np.maximum(e, 0), 0)
        return e.max(), int(e.argmax()), (p * w[:, None]).sum(0) / w.sum()

    while len(boxes) < most:
        at = max(range(len(boxes)), key=lambda i: error(boxes[i])[0])
        e, axis, mean = error(boxes[at])
        if e <= 0:
            break
        low = points[boxes[at], axis] <= mean[axis]
        boxes[at : at + 1] = [boxes[at][low], boxes[at][~low]]
    return {frozenset(map(int, b)) for b in boxes}


@pytest.mark.parametrize("most", [2, 9])
def test_boxes_of_several_images(spark, most):
    rng = np.random.default_rng(most)
    images = {0: rng.integers(0, 500, (60, 4)), 1: 2 ** rng.integers(0, 9, (40, 4)), 2: np.full((3, 4), 7), 3: rng.integers(0, 3, (4, 4))}
    weights = {i: rng.integers(1, 9, len(p)).astype(float) for i, p in images.items()}
    rows = [(i, *map(float, q), float(w)) for i, p in images.items() for q, w in zip(p, weights[i])]
    df = spark.createDataFrame(rows, "image int, p0 double, p1 double, p2 double, p3 double, w double")
    got = {}
    for r in palettes.boxes(df, most).collect():
        got.setdefault(r["image"], {}).setdefault(r["box"], set()).add((r["p0"], r["p1"], r["p2"], r["p3"]))
    for i, p in images.items():
        want = {frozenset(tuple(map(float, p[k])) for k in b) for b in plain(p.astype(float), weights[i], most)}
        assert {frozenset(b) for b in got[i].values()} == want


def test_coarser_colours_and_empty(spark):
    df = spark.createDataFrame([(0, k, 0, 0, 255) for k in range(16)] + [(1, 3, 0, 0, 255)] * 2, "image int, red int, green int, blue int, alpha int")
    got = sorted(tuple(r) for r in palettes.histograms(df, 5).collect())
    assert got == [(0, 0, 0, 0, 255, 4), (0, 4, 0, 0, 255, 4), (0, 8, 0, 0, 255, 4), (0, 12, 0, 0, 255, 4), (1, 3, 0, 0, 255, 2)]
    assert palettes.palettes(palettes.histograms(df.limit(0)), 4).count() == 0
    few = palettes.palettes(palettes.histograms(df.where("image = 1")), 4).collect()
    assert [tuple(r) for r in few] == [(1, 3, 0, 0, 255)]

"""Derivatives of a grid with holes against plain arrays, and what its plan may not hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import focal

CELLS = "r int, c int, v double"


def by_arrays(v, step=100.0):
    gy, gx = np.gradient(v, step)
    wide = lambda n: np.pad(v, n, mode="edge")
    around = lambda n: [wide(n)[y : y + v.shape[0], x : x + v.shape[1]] for y in range(2 * n + 1) for x in range(2 * n + 1)]
    s, aspect = math.pi / 2 - np.arctan(np.hypot(gx, gy)), np.arctan2(-gy, gx)
    shade = math.sin(math.radians(45)) * np.sin(s) + math.cos(math.radians(45)) * np.cos(s) * np.cos(math.radians(45) - math.pi / 2 - aspect)
    return [
        np.degrees(np.arctan(np.hypot(gx, gy))), np.gradient(gy, step, axis=0) + np.gradient(gx, step, axis=1), v - np.mean(around(3), axis=0),
        np.mean([np.abs(a - v) for a in around(1)], axis=0), 255 * (shade + 1) / 2,
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_dem_stack_of_many_tiles(spark, monkeypatch, seed):
    """No task holds all values for their median, nor all cells of the box."""
    monkeypatch.setattr(F, "percentile", None)
    monkeypatch.setattr(focal, "dense", None)
    rng = np.random.default_rng(seed)
    v, valid = rng.integers(0, 40_000, (21, 27)).astype(float), rng.random((21, 27)) < 0.7
    valid[0, 0] = valid[-1, -1] = True
    valid[8:16, 5:15] = False
    valid[0, 3] = valid.sum() % 2 == seed - 1  # an odd and an even number of values
    cells = [(int(y) - 6, int(x) + 4, float(v[y, x])) for y, x in np.argwhere(valid)]
    got = {(x.r + 6, x.c - 4): x[2:] for x in focal.dem_stack(spark.createDataFrame(cells, CELLS), 100.0, 8).collect()}
    want = by_arrays(np.where(valid, v, np.median(v[valid])))
    assert set(got) == {(int(y), int(x)) for y, x in np.argwhere(valid)}
    for (y, x), found in got.items():
        assert found == pytest.approx([a[y, x] for a in want], rel=1e-9, abs=1e-9)


def test_dem_stack_of_nothing(spark):
    for cells in ([], [(1, 2, None), (3, 3, None)]):
        assert focal.dem_stack(spark.createDataFrame(cells, CELLS)).collect() == []

"""Window sums against sums over arrays, over tiles of many sizes, and the choice of a window."""

import numpy as np
import pytest

from cellweave.operators import integral

CELLS = "r int, c int, a double, b int"


def grid(seed, shape, share=0.3):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(shape) < share, rng.integers(-5, 9, shape), 0).astype(float)
    b = (rng.random(shape) < 0.8).astype(int)
    return a, b, [(int(y), int(x), float(a[y, x]), int(b[y, x])) for y in range(shape[0]) for x in range(shape[1]) if a[y, x] or b[y, x]]


@pytest.mark.parametrize("tile, size, step", [(8, 5, 1), (8, 19, 3), (16, 16, 4), (4, 1, 1), (64, 7, 2)])
def test_sums_of_all_windows(spark, tile, size, step):
    shape = (37, 45)
    a, b, rows = grid(tile, shape)
    outside = [(-1, 3, 99.0, 9), (37, 0, 99.0, 9), (0, 45, 99.0, 9)]
    got = {(x.r0, x.c0): (x.a, x.b) for x in integral.window_sums(spark.createDataFrame(rows + outside, CELLS), ["a", "b"], shape, size, step, tile).collect()}
    want = {(y, x): (a[y : y + size, x : x + size].sum(), b[y : y + size, x : x + size].sum()) for y in range(0, shape[0] - size + 1, step) for x in range(0, shape[1] - size + 1, step)}
    assert got == want


def test_tiles_without_cells(spark):
    rows = [(0, 0, 1.0, 1), (30, 30, 2.0, 1), (0, 30, 4.0, 1)]
    got = {(x.r0, x.c0): x.a for x in integral.window_sums(spark.createDataFrame(rows, CELLS), ["a"], (32, 32), 31, 1, 4).collect()}
    assert got == {(0, 0): 7.0, (0, 1): 6.0, (1, 0): 2.0, (1, 1): 2.0}
    none = spark.createDataFrame([], CELLS)
    assert {x.a for x in integral.window_sums(none, ["a"], (9, 9), 3, 1, 4).collect()} == {0.0}
    assert integral.window_sums(none, ["a"], (2, 9), 3).collect() == []


def test_best_window(spark):
    valid = np.ones((20, 24), int)
    valid[0:9, 0:9] = 0
    positive = np.zeros((20, 24), int)
    positive[0:6, 0:6] = 1  # most, but not valid
    positive[12:16, 3:7] = 1
    positive[2:6, 14:18] = 1  # as many, and first
    df = spark.createDataFrame([(y, x, int(positive[y, x]), int(valid[y, x])) for y in range(20) for x in range(24)], "r int, c int, positive int, valid int")
    (row,) = integral.best_window(df, (20, 24), 6, 1, 0.95, 8).collect()
    assert (row.r0, row.c0, row.size, row.positives, row.valids) == (0, 12, 6, 16, 36) and row.positive_share == pytest.approx(16 / 36)
    assert integral.best_window(df.where("r < 5"), (20, 24), 10).collect() == []

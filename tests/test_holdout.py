"""Windows without leaks: plain loops over arrays for both ways of holding out, and weights from known truth alone."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import holdout

SHAPE, PATCH, STEP = (40, 46), 8, 4


def cells(seed):
    r = random.Random(seed)
    return [(y, x, int(r.random() < 0.08)) for y in range(SHAPE[0]) for x in range(SHAPE[1]) if r.random() < 0.7 and not (8 <= y < 16 and 8 <= x < 16)]


def order_of(w):
    return ((w[0] * 31 + w[1] * 17) % 101, *w)


def plain(rows, blocks=None, block=16, share=0.3, collar=3, least=3, negatives=0.35):
    """(r0, c0) to use and truth."""
    data, truth = {(y, x) for y, x, _ in rows}, {(y, x) for y, x, t in rows if t}
    high, wide = (-(-n // PATCH) * PATCH for n in SHAPE)
    inside = lambda w: {(y, x) for y in range(w[0], w[0] + PATCH) for x in range(w[1], w[1] + PATCH)}
    grid = [(y, x) for y in range(0, high, PATCH) for x in range(0, wide, PATCH) if inside((y, x)) & data]
    if blocks is None:
        test = sorted(grid, key=order_of)[: round(share * len(grid))]
        gone = set().union(*map(inside, test)) if test else set()
        drop = lambda w: len(inside(w) & gone) > 0.25 * PATCH * PATCH
    else:
        gone = {(y, x) for y in range(SHAPE[0]) for x in range(SHAPE[1]) if (y // block, x // block) in blocks}
        test = [w for w in grid if inside(w) <= gone]
        near = {(y + a, x + b) for y, x in gone for a in range(-collar, collar + 1) for b in range(-collar, collar + 1)}
        drop = lambda w: bool(inside(w) & near)
    known = truth - gone
    out, pos, neg = {(*w, "test"): len(inside(w) & truth) for w in test}, [], []
    for w in [(y, x) for y in range(0, high - PATCH + 1, STEP) for x in range(0, wide - PATCH + 1, STEP)]:
        n = len(inside(w) & known)
        if drop(w):
            out[*w, "dropped"] = n
        else:
            (pos if n >= least else neg).append((w, n))
    keep = round(negatives * len(pos) / (1 - negatives))
    neg = sorted(neg, key=lambda x: order_of(x[0]))
    out |= {(*w, "positive"): n for w, n in pos} | {(*w, "negative" if i < keep else "spare"): n for i, (w, n) in enumerate(neg)}
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "r int, c int, t int")
    got = holdout.train_windows(df, SHAPE, PATCH, STEP, order=(F.col("r0") * 31 + F.col("c0") * 17) % 101, **more).collect()
    return {(x.r0, x.c0, x.use): x.truth for x in got}


@pytest.mark.parametrize("least", [3, 6])
def test_drawn(spark, least):
    rows = cells(least)
    assert found(spark, rows + rows[:9], least=least) == plain(rows, least=least)


def test_blocks(spark):
    rows = cells(1)
    held = [(0, 1), (2, 0), (2, 2)]
    got = found(spark, rows, held=spark.createDataFrame(held, "block_row int, block_col int"), block=16)
    assert got == plain(rows, set(held)) and any(u == "test" for *_, u in got)


def test_no_training_window_knows_the_test_truth(spark):
    """Truth in the held block alone: no window knows any, and no weight tells of it."""
    rows = [(y, x, int(y == 5 and 2 <= x < 12)) for y in range(SHAPE[0]) for x in range(SHAPE[1])]
    got = found(spark, rows, held=spark.createDataFrame([(0, 0)], "block_row int, block_col int"), block=16)
    assert all(n == 0 for (*_, u), n in got.items() if u != "test") and sum(n for (*_, u), n in got.items() if u == "test") == 10
    truth = spark.createDataFrame([(5, 5), (20, 20)], "r int, c int")
    unknown = spark.createDataFrame([(y, x) for y in range(16) for x in range(16)] + [(20, 21)], "r int, c int")
    w = {(x.r, x.c): x.w for x in holdout.training_weights(truth, unknown).collect()}
    assert w[20, 20] == 0 and w[21, 20] == pytest.approx(1 / 3) and (20, 21) not in w and not any(y < 16 for y, _ in w)


def test_nothing(spark):
    got = found(spark, [])
    assert {u for *_, u in got} == {"spare"} and not any(got.values())

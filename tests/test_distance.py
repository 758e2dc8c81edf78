"""The separable distance transform against all pairs, on levels of tiles and on dense blocks."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import distance

CELLS = "r int, c int"


def brute(cells, truth):
    t = np.array(truth)
    return {(r, c): int(((t - (r, c)) ** 2).sum(1).min()) for r, c in cells}


def found(spark, cells, truth, **more):
    got = distance.distance_to(spark.createDataFrame(cells, CELLS), spark.createDataFrame(truth, CELLS), **more).collect()
    assert len(got) == len(set(cells))
    return {(x.r, x.c): round(x.d**2) for x in got}


@pytest.mark.parametrize("tile, few", [(8, 4), (128, 256)])
def test_all_pairs(spark, tile, few):
    r = random.Random(tile)
    blobs = [(r.randrange(-60, 200), r.randrange(-60, 300)) for _ in range(5)]
    truth = [(y + r.randrange(9), x + r.randrange(9)) for y, x in blobs for _ in range(30)]
    cells = [(r.randrange(-90, 260), r.randrange(-90, 340)) for _ in range(300)] + truth[:20]
    assert found(spark, cells, truth, tile=tile, few=few) == brute(cells, truth)


def test_lines_far_away(spark):
    truth = [(0, x) for x in range(0, 400)] + [(y, -300) for y in range(0, 300, 7)]
    cells = [(y, x) for y in (1, 90, 399) for x in range(-350, 700, 37)]
    assert found(spark, cells, truth, tile=16, few=4) == brute(cells, truth)


def test_ties_and_few_columns(spark):
    truth = [(0, 0), (0, 10), (10, 0), (10, 10)] * 2
    assert found(spark, [(5, 5), (5, 5), (0, 5)], truth, tile=2, few=4) == {(5, 5): 50, (0, 5): 25}


def test_no_truth_and_no_cells(spark):
    none = spark.createDataFrame([], CELLS)
    one = spark.createDataFrame([(1, 2)], CELLS)
    assert [tuple(x) for x in distance.distance_to(one, none).collect()] == [(1, 2, None)]
    assert distance.distance_to(none, one).collect() == []


def test_a_dense_block_far_from_its_cells(spark):
    """512 x 512 truth cells, as many cells 3000 rows and 2000 columns away: some 7e10 pairs if each met each."""
    square = spark.range(512 * 512).select((F.col("id") / 512).cast("int").alias("r"), (F.col("id") % 512).cast("int").alias("c"))
    cells = square.select((F.col("r") + 3000).alias("r"), (F.col("c") + 2000).alias("c"))
    start = time.perf_counter()
    d = distance.distance_to(cells, square)
    corner = F.sqrt(F.pow(F.col("r") - 511, 2) + F.pow(F.col("c") - 511, 2))  # the block's nearest corner
    row = d.agg(F.count("*").alias("n"), F.max(F.abs(F.col("d") - corner)).alias("off")).first()
    assert row.n == 512 * 512 and row.off < 1e-9
    assert time.perf_counter() - start < 120

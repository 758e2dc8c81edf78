"""What operators leave for later is small: lineage ends where facts are asked for several times."""

import math

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import audits, focal, integral, kernels, scoring
from cellweave.sources import codec

CELLS = "r int, c int"


def scans(df) -> int:
    """How many leaves a plan has."""
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def world(spark):
    truth = spark.createDataFrame([(r, 5) for r in range(10)], CELLS)
    pred = spark.createDataFrame([(n, r, 5 + k, 0.5) for n, k in (("a", 0), ("b", 1)) for r in range(10)], "candidate string, r int, c int, p double")
    return truth, pred


def test_components_are_planned_once(spark):
    parts = scoring.components(*world(spark), F.floor(F.col("r") / 4))
    assert scans(parts) == 1
    both = audits.paired_folds(parts, "a", "b")
    assert scans(both) == 4  # each side of the contrast reads the parts and, summed, all of them
    got = {x.part: x.contrast for x in both.collect()}
    assert sorted(got) == [-1, 0, 1, 2] and all(v < 0 for v in got.values())


def test_every_candidate_is_judged(spark):
    agreement = spark.createDataFrame([("a", 3, 4), ("b", 1, 4), ("d", 3, 4)], "candidate string, gain long, scoreable long")
    whole = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("c", 0.2), ("d", 0.3)], "candidate string, dti double")
    got = {x.candidate: x.conflict for x in audits.majority_conflicts(agreement, whole, "c").collect()}
    assert got == {"a": True, "b": False, "d": False}


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_areas_are_joined_tile_by_tile(spark):
    cells = spark.createDataFrame([(r, c, 1) for r in range(0, 20, 3) for c in range(0, 20, 5)], "r int, c int, w int")
    area = integral.summed_area(cells, ["w"], (20, 20), 8)
    assert "MapInPandas" not in plan(area) and area.count() == 9
    assert max(np.frombuffer(x.area).max() for x in area.collect()) == 28


def test_run_bytes_need_no_python(spark):
    lengths = [1, 127, 128, 300, 16383, 16384, 20000]
    cells = spark.createDataFrame(list(enumerate(lengths)), "r int, n int").select("r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"), F.lit(1.0).alias("p"))
    rows = codec.encode_rows(cells)
    assert "Python" not in plan(rows) and "pandas" not in plan(rows)
    assert {x.r: bytes(x.blob) for x in rows.collect()} == {i: codec.write_length(n) + b"\x01" for i, n in enumerate(lengths)}
    assert codec.value_histogram(codec.decode_rows(rows)).first().ones == sum(lengths)
    assert "MapInPandas" in plan(codec.decode_rows(rows))  # runs leave a task's Python a few rows at a time


def test_derivatives_filter_no_line_by_itself(monkeypatch):
    a = np.random.default_rng(1).random((30, 50))
    s = 2.0 / math.sqrt(2)
    by_row = kernels.smooth(a, s, (1, 0), "symmetric", 8.0)
    want = kernels.smooth(by_row, s, (1, 0), "symmetric", 8.0), kernels.smooth(by_row, s, (0, 1), "symmetric", 8.0)
    got = kernels.hessian(a, 2.0)
    assert np.allclose(got[0], want[0], atol=1e-12) and np.allclose(got[1], want[1], atol=1e-12)
    monkeypatch.setattr(kernels, "along", None)
    kernels.hessian(a + 1, 2.0)


def test_dem_stack_reads_its_grid_once_written(spark):
    grid = spark.createDataFrame([(r, c, float(r * r + 3 * c)) for r in range(6) for c in range(7) if (r, c) != (2, 3)], "r int, c int, v double")
    found = focal.dem_stack(grid)
    assert scans(found) == 7  # gradients, and for each of two windows the grid, its box and what it is met by
    assert found.count() == 41 and found.columns == ["r", "c", "slope", "curvature", "tpi", "tri", "hillshade"]
